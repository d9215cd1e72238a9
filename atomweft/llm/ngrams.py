"""Language-model scoring with an Elias-Fano n-gram trie in the shared folder.

Tokens are the words of a text, A-Z lower-cased, and one end. The trie has three levels, each
cut into shard files. Level one: the words' hashes, sorted and Elias-Fano coded, and their
counts; a word's id is its place. Levels two and three: for each context, which is an entry of
the level above, a monotone Elias-Fano pointer to its range of following words. A following
word is stored as its rank in the file's vocabulary plus the last value of the range before,
so all values of a file are one monotone Elias-Fano sequence; a word is found by successor
search for its rank, relative to its context, within the range. With it stand its discounted
probability and the context's back-off weight, quantised to 16 bits in logarithm and stored as
places in a table of the codes that occur.

p(w | u v) = max(c(u v w) - D, 0) / c(u v) + D n(u v) / c(u v) * p(w | v), where n counts the
different words that follow; p(w | v) likewise down to the additive estimate of the word. It
sums to one over the vocabulary and one unknown word; a context that was never followed hands
over all. Nothing is pruned.

Texts are tokenised once, into chunk files of some million tokens. For each level a chunk
sends its distinct keys with their counts to the shards they belong to, Elias-Fano coded; a
shard adds them up, writes its file, looks up each chunk's keys in it and sends the answers
back. So no task opens more than its shard or its chunk, whatever the model's size, and equal
n-grams of a chunk are one. Documents that are only scored send counts of zero. A context with
more than a shard's share of the tokens is spread over files by the following word.

Words are told apart by 63 bits of XXH64: with a thousand million different words the chance
that any two of them meet is about one in eighteen, and then those two are counted as one.

Null text is empty (one end). An empty training part gives the additive estimate with N = 0.
Repeated rows are scored each. Only doc_id, text and what `train` reads are read.
"""

from __future__ import annotations

import io
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, store
from .elias_fano import EliasFano, _pack, _unpack

DISCOUNT = 0.8
SHARD_BYTES = 16 << 20
CHUNK_TOKENS = 1_500_000
MOST_TASKS = 65_536
END = b"\n"  # no word has white space
STEP = 1024.0  # codes a power of two
ZERO = 65_535
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13)
VALUES = np.append(2.0 ** (-np.arange(ZERO) / STEP), 0.0)
BLOBS = "chunk long, file int, b binary"
ANSWERS = "chunk long, file int, n long, a binary, x binary"  # a: places of n keys, x: what else is known of them


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of binary texts without what is between them: how many each text has, their lengths, their bytes in lower case."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)
    held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = ~_SPACE[held]
    edge = np.zeros(len(held) + 1, bool)  # where another text begins
    edge[offsets] = True
    edge[1:-1] |= ~word[:-1]
    starts = np.flatnonzero(word & edge[:-1])
    edge[1:-1] = ~word[1:]
    edge[offsets] = True
    lengths = np.flatnonzero(word & edge[1:]) + 1 - starts
    return np.diff(np.searchsorted(starts, offsets)), lengths, _LOWER[held[word]]


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities; the last code stands for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-np.log2(np.maximum(p, 1e-300)) * STEP), 0, ZERO - 1), ZERO).astype("<u2")


def word_key(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word) >> 1


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def word_keys(held: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """word_key of many words: XXH64 of all that have a length at once, of 32 bytes and more one by one."""
    lengths, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    for n in np.unique(lengths).tolist():
        which = np.flatnonzero(lengths == n)
        if n >= 32:
            out[which] = [word_key(held[a : a + n].tobytes()) for a in offsets[which].tolist()]
            continue
        padded = np.zeros((len(which), 32), np.uint8)
        padded[:, :n] = held[offsets[which][:, None] + np.arange(n)]
        h, at = np.full(len(which), _P5 + np.uint64(n)), n // 8 * 8
        for lane in padded.view("<u8").T[: n // 8]:
            h = _turned(h ^ _turned(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        if n - at >= 4:
            h = _turned(h ^ padded.view("<u4")[:, at // 4].astype(np.uint64) * _P1, 23) * _P2 + _P3
            at += 4
        for k in range(at, n):
            h = _turned(h ^ padded[:, k].astype(np.uint64) * _P5, 11) * _P1
        for shift, by in ((33, _P2), (29, _P3)):
            h = (h ^ h >> np.uint64(shift)) * by
        out[which] = ((h ^ h >> np.uint64(32)) >> np.uint64(1)).view(np.int64)
    return out


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with its inverse, of numbers from 0; where key and place fit 63 bits both are sorted as one number."""
    low = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (63 - low):
        return np.unique(keys, return_inverse=True)
    both = np.sort(keys << low | np.arange(len(keys)))
    where, keys = both & ((1 << low) - 1), both >> low
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    back = np.empty(len(keys), np.int64)
    back[where] = np.cumsum(first) - 1
    return keys[first], back


# files and blobs ----------------------------------------------------------------------------


def _save(uri: str, **arrays: np.ndarray) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    store.write_atomic(uri, held.getvalue())


def _load(uri: str) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(memoryview(store.mapped(uri)))) as z:
        return {k: z[k] for k in z.files}


def _least_type(x: np.ndarray) -> str:
    top = int(x.max(initial=0))
    return "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"


def _planes(arrays) -> tuple[bytes, bytes]:
    """Widths, and the bytes of arrays of unsigned numbers, low bytes before high ones."""
    kinds = [_least_type(x) for x in arrays]
    return bytes(int(k[2]) for k in kinds), b"".join(x.astype(k).view(np.uint8).reshape(len(x), int(k[2])).T.tobytes() for x, k in zip(arrays, kinds))


def _unplanes(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(plane.T).view(f"<u{width}").reshape(n).astype(np.int64)


def _numbers(x: np.ndarray) -> bytes:
    """Unsigned numbers, compressed."""
    width, raw = _planes([x])
    return width + pa.compress(raw, "zstd", asbytes=True)


def _unnumbers(b: bytes, n: int) -> np.ndarray:
    return _unplanes(pa.decompress(b[1:], n * b[0], "zstd", asbytes=True), 0, n, b[0])


def _codes(alpha: np.ndarray, beta: np.ndarray) -> bytes:
    """Codes of probabilities and back-offs, compressed: where few pairs of them occur, their places in a table, frequent ones first. Deflate makes them smaller than zstd does."""
    table, which = grouped(alpha.astype(np.int64) << 16 | beta)
    joined = 5 * len(table) < len(which)
    if joined:
        by = np.argsort(-np.bincount(which), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        alpha, beta = table[by], rank[which]
    widths, raw = _planes([alpha, beta])
    return (len(table) if joined else 0).to_bytes(4, "little") + widths + zlib.compress(raw, 1)


def _uncodes(b: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    size, raw = int.from_bytes(b[:4], "little"), zlib.decompress(b[6:])
    first = _unplanes(raw, 0, size or n, b[4])
    second = _unplanes(raw, (size or n) * b[4], n, b[5])
    return (first[second] >> 16, first[second] & 0xFFFF) if size else (first, second)


def _steps(at: np.ndarray) -> np.ndarray:
    """Ascending places, -1 for none, as steps from the one before; 0 for none."""
    top = np.maximum.accumulate(at + 1)
    return np.where(at >= 0, top - np.concatenate([[0], top[:-1]]), 0)


def _places(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, np.cumsum(steps) - 1, -1)


def blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts; a few keys go as they are."""
    if len(keys) < 64:
        return b"\0" + keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes()
    return b"\1" + EliasFano.encode(keys).to_bytes() + _numbers(counts)


def unblob(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not b[0]:
        both = np.frombuffer(b, "<i8", -1, 1)
        return both[: len(both) // 2], both[len(both) // 2 :]
    ef, at = EliasFano.from_buffer(b, 1)
    keys = ef.decode()
    return keys, _unnumbers(b[at:], len(keys))


def _order(files: np.ndarray) -> np.ndarray:
    """A stable order by file; of numbers of 16 bits that takes no comparisons."""
    return np.argsort(files.astype(np.uint16) if int(files.max(initial=0)) < 1 << 16 else files, kind="stable")


def blobs(chunk: int, files: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A row for each file; keys ascend within a file."""
    order = _order(files)
    files, keys, counts = files[order], keys[order], counts[order]
    edges = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]])) if len(files) else np.zeros(0, np.int64)
    ends = np.append(edges[1:], len(files))
    rows = [blob(keys[a:b], counts[a:b]) for a, b in zip(edges.tolist(), ends.tolist())]
    return pd.DataFrame({"chunk": np.full(len(rows), chunk), "file": files[edges].astype(np.int32), "b": rows})


def merged(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All keys of the blobs, ascending, their total counts, and for each blob the places of its own keys among them."""
    parts = [unblob(b) for b in pdf["b"]]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(first) - 1
    ends = np.cumsum([len(k) for k, _ in parts])
    return np.split(back, ends[:-1]), keys[first], np.add.reduceat(counts[order], np.flatnonzero(first)) if len(keys) else counts


# levels -------------------------------------------------------------------------------------


class Codes:
    """Codes by their place in a table of those that occur, bit-packed."""

    def __init__(self, buf, at: int):
        self.n, size, self.width, words = np.frombuffer(buf, "<u8", 4, at).tolist()
        self.table = np.frombuffer(buf, "<u2", size, at + 32)
        self.packed = np.frombuffer(buf, "<u8", words, at + 32 + -(-2 * size // 8) * 8)
        self.end = at + 32 + -(-2 * size // 8) * 8 + 8 * words

    @staticmethod
    def encode(codes: np.ndarray) -> bytes:
        table = np.flatnonzero(np.bincount(codes, minlength=ZERO + 1))
        places = np.zeros(ZERO + 1, np.int64)
        places[table] = np.arange(len(table))
        which = places[codes]
        width = max(1, (len(table) - 1).bit_length()) if len(table) else 1
        packed, raw = _pack(which.astype(np.uint64), width), table.astype("<u2").tobytes()
        return np.array([len(codes), len(table), width, len(packed)], "<u8").tobytes() + raw + b"\0" * (-len(raw) % 8) + packed.tobytes()

    def many(self, at: np.ndarray) -> np.ndarray:
        return self.table[_unpack(self.packed, at, self.width)] if len(at) else np.zeros(0, "<u2")


class Words:
    """A shard of the first level: sorted keys and counts."""

    def __init__(self, buf):
        self.keys, at = EliasFano.from_buffer(buf)
        width = int(np.frombuffer(buf, "<u1", 1, at)[0])
        self.count = np.frombuffer(buf, f"<u{width}", len(self.keys), at + 1)

    @staticmethod
    def encode(keys: np.ndarray, counts: np.ndarray) -> bytes:
        kind = _least_type(counts)
        return EliasFano.encode(keys).to_bytes() + bytes([int(kind[2])]) + counts.astype(kind).tobytes()

    @cached_property
    def known(self) -> np.ndarray:
        return self.keys.decode()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (-1: none) and counts of many keys."""
        known = self.known
        if not len(known):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        return np.where(hit, at, -1), np.where(hit, self.count[at].astype(np.int64), 0)


class Level:
    """A shard of a further level: pointers, vocabulary and words Elias-Fano coded, codes of probabilities and back-offs."""

    def __init__(self, buf):
        self.pointers, at = EliasFano.from_buffer(buf)
        self.vocabulary, at = EliasFano.from_buffer(buf, at)
        self.values, at = EliasFano.from_buffer(buf, at)
        self.alpha = Codes(buf, at)
        self.backoff = Codes(buf, self.alpha.end)

    @staticmethod
    def encode(contexts: int, context: np.ndarray, word: np.ndarray, counts: np.ndarray, discount: float, total: int | None = None) -> bytes:
        """From entries sorted by context and word; `total` is the only context's count where other files have entries of it too."""
        seen = np.bincount(context, minlength=contexts)
        totals = np.bincount(context, counts, contexts) if total is None else np.full(contexts, float(total))
        totals = np.maximum(totals, 1)
        pointers = np.concatenate([[0], np.cumsum(seen)])
        vocabulary, rank = grouped(word)
        used = np.flatnonzero(seen)
        tops = rank[pointers[used + 1] - 1] if len(used) else np.zeros(0, np.int64)
        base = np.zeros(contexts, np.int64)
        base[used] = np.cumsum(tops) - tops
        parts = [EliasFano.encode(x).to_bytes() for x in (pointers, vocabulary, rank + base[context])]
        return b"".join([*parts, Codes.encode(quantise(np.maximum(counts - discount, 0) / totals[context])), Codes.encode(quantise(discount * seen / totals))])

    @cached_property
    def decoded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For many look-ups in one shard: values, vocabulary and pointers."""
        return self.values.decode(), self.vocabulary.decode(), self.pointers.decode()

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1: unseen), probability codes and back-off codes of many (context, word): successor search in each context's range."""
        if not len(self.values):
            return np.full(len(word), -1), np.full(len(word), ZERO), self.backoff.many(context)
        values, vocabulary, pointers = self.decoded
        lo, hi = pointers[context], pointers[context + 1]
        asked, back = grouped(word)
        rank = np.minimum(np.searchsorted(vocabulary, asked), len(vocabulary) - 1)
        listed, rank = (vocabulary[rank] == asked)[back], rank[back]
        target = rank + np.where(lo > 0, values[np.maximum(lo, 1) - 1], 0)
        at = np.minimum(np.maximum(np.searchsorted(values, target), lo), len(values) - 1)
        hit = listed & (at < hi) & (values[at] == target)
        return np.where(hit, at, -1), np.where(hit, self.alpha.many(at), ZERO), self.backoff.many(context)

    def one(self, context: int, word: int) -> tuple[int, float, float]:
        """Place (-1: unseen), probability and back-off of one, by selects on the mapped file alone."""
        lo, hi = self.pointers[context], self.pointers[context + 1]
        rank, weight = self.vocabulary.successor(word, 0, len(self.vocabulary)), float(VALUES[self.backoff.many(np.array([context]))[0]])
        if rank < len(self.vocabulary) and self.vocabulary[rank] == word:
            target = rank + (self.values[lo - 1] if lo else 0)
            at = self.values.successor(target, lo, hi)
            if at < hi and self.values[at] == target:
                return at, float(VALUES[self.alpha.many(np.array([at]))[0]]), weight
        return -1, 0.0, weight


class Layout:
    """Which file of a level has an entry, and its key there. Contexts are entries of the level above, whose files start at `bases`; words go from 0 to size - 1."""

    def __init__(self, bases: np.ndarray, size: int, heavy: dict[int, int], share: int):
        self.bases, self.size, self.heavy = bases, size, heavy
        self.hot = np.array(sorted(heavy), np.int64)
        self.spread = np.array([max(1, -(-heavy[h] // share)) for h in self.hot.tolist()], np.int64)
        self.plain = len(bases) - 1
        self.first = self.plain + np.cumsum(self.spread) - self.spread
        self.files = self.plain + int(self.spread.sum())

    def place(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        file = np.clip(np.searchsorted(self.bases, context, side="right") - 1, 0, max(0, self.plain - 1))
        key = (context - self.bases[file]) * self.size + word
        if len(self.hot):
            k = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[k] == context
            file = np.where(hot, self.first[k] + word * self.spread[k] // self.size, file)
            key = np.where(hot, word, key)
        return file, key

    def context_of(self, file: int) -> int | None:
        """The only context of a spread context's file."""
        return None if file < self.plain else int(self.hot[np.searchsorted(self.first, file, side="right") - 1])

    def split(self, file: int, keys: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, int | None]:
        """Contexts of a file, the (local) context and the word of each key, and the total of an only context."""
        only = self.context_of(file)
        if only is not None:
            return 1, np.zeros(len(keys), np.int64), keys, self.heavy[only]
        return int(self.bases[file + 1] - self.bases[file]), keys // self.size, keys % self.size, None


class Model:
    """Where the files are, how many entries each has, and what holds for all of them: a few numbers a file."""

    def __init__(self, folder: str, bits: int, total: int, discount: float):
        self.folder, self.bits, self.total, self.discount = folder, bits, total, discount
        self.share = max(1, total >> bits)
        self.bases: list[np.ndarray] = []  #: by level
        self.layouts: list[Layout] = []
        self.backoff: list[dict[int, int]] = []  #: codes of spread contexts, by level
        self.words = 0

    def path(self, level: int, file: int) -> str:
        return f"{self.folder}/level-{level}-{file:07d}.bin"

    def unigram(self, counts):
        return (counts + 0.5) / (self.total + 0.5 * (self.words + 1))

    def sized(self, files: int, meta: list) -> tuple[np.ndarray, dict[int, int]]:
        """The bases of a finished level's files, and its frequent entries with their counts."""
        n = np.zeros(files, np.int64)
        for r in meta:
            n[r["file"]] = r["n"]
        bases, heavy = np.concatenate([[0], np.cumsum(n)]), {}
        for r in meta:
            at, counts = np.frombuffer(r["a"], "<i8").reshape(2, -1)
            heavy |= dict(zip((at + bases[r["file"]]).tolist(), counts.tolist()))
        return bases, heavy

    def probability(self, words: list[str]) -> float:
        """Of the last word after at most two before it ("\\n" is the end, None the begin), by selects on the mapped files."""
        keys = [None if w is None else word_key(w.encode().translate(_LOWER.tobytes())) for w in words[-3:]]
        ids, count = [], 0
        for k in keys:
            if k is None:
                ids.append(self.words)
                continue
            file = k >> (63 - self.bits)
            place, counts = Words(store.mapped(self.path(1, file))).find(np.array([k])) if self.bases[0][file + 1] > self.bases[0][file] else ([-1], [0])
            ids.append(int(place[0] + self.bases[0][file]) if place[0] >= 0 else -1)
            count = int(counts[0])
        p, word = float(self.unigram(count)), ids[-1] if ids[-1] >= 0 else self.words
        context = ids[-2] if len(ids) > 1 else -1
        if context >= 0:
            alpha, beta, _ = self._step(2, context, word)
            p = alpha + beta * p
            if len(ids) > 2 and ids[-3] >= 0 and (pair := self._step(2, ids[-3], context)[2]) >= 0:
                alpha, beta, _ = self._step(3, pair, word)
                p = alpha + beta * p
        return p

    def _step(self, level: int, context: int, word: int) -> tuple[float, float, int]:
        layout = self.layouts[level - 2]
        file = int(layout.place(np.array([context]), np.array([word]))[0][0])
        only, place, alpha = layout.context_of(file), -1, 0.0
        beta = float(VALUES[self.backoff[level - 2].get(context, ZERO)])
        if self.bases[level - 1][file + 1] > self.bases[level - 1][file]:
            place, alpha, own = Level(store.mapped(self.path(level, file))).one(0 if only is not None else context - int(layout.bases[file]), word)
            beta = beta if only is not None else own
        return alpha, beta or 1.0, place + int(self.bases[level - 1][file]) if place >= 0 else -1


# chunks -------------------------------------------------------------------------------------


def cut(docs: DataFrame, folder: str, chunk_tokens: int) -> DataFrame:
    """Tokenise rows (doc_id, text, train) into chunk files; a row a chunk: chunk, docs, tokens (both of training)."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, n = TaskContext.get().partitionId(), 0, 0
        parts, doc, train, size = [], [], [], []

        def flush():
            lengths, held = (np.concatenate(x) for x in zip(*parts))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
            local = pa.concat_arrays([words.dictionary, pa.array([END], pa.large_binary())])
            keys, place = np.unique(word_keys(np.frombuffer(local.buffers()[2], np.uint8), np.frombuffer(local.buffers()[1], "<i8", len(local) + 1)), return_inverse=True)
            chunk, width = part << 24 | seq, max(1, (len(keys) - 1).bit_length())
            sizes, known, mine = np.concatenate(size), np.array([d is not None for d in doc]), np.array(train, bool)
            index, inner = np.full(int(sizes.sum()), place[-1]), np.ones(int(sizes.sum()), bool)
            inner[np.cumsum(sizes) - 1] = False
            index[inner] = place[words.indices.to_numpy()]
            store.write_atomic(f"{folder}/keys/{chunk}.bin", EliasFano.encode(keys).to_bytes())
            _save(
                f"{folder}/tokens/{chunk}.npz", words=np.array(len(keys)), index=_pack(index.astype(np.uint64), width), width=np.array(width), size=sizes,
                doc=np.array([d or 0 for d in doc], np.int64), known=known, train=mine,
            )
            return pa.RecordBatch.from_pydict({"chunk": [chunk], "docs": [int(mine.sum())], "tokens": [int(sizes[mine].sum())]})

        for batch in batches:
            ids, trained = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            each, lengths, held = split_words(batch.column(1))
            ends, bytes_to = np.cumsum(each + 1), np.concatenate([[0], np.cumsum(lengths)])
            words_to, a = np.concatenate([[0], np.cumsum(each)]), 0
            while a < len(ids):  # a chunk ends with the text that fills it
                b = min(len(ids), a + 1 + int(np.searchsorted(ends[a:] - (ends[a - 1] if a else 0), chunk_tokens - n)))
                v, w = words_to[a], words_to[b]
                parts.append((lengths[v:w], held[bytes_to[v] : bytes_to[w]]))
                size.append(each[a:b] + 1)
                doc += ids[a:b]
                train += map(bool, trained[a:b])
                n, a = n + int(size[-1].sum()), b
                if n >= chunk_tokens:
                    yield flush()
                    seq, n, parts, doc, train, size = seq + 1, 0, [], [], [], []
        if doc:
            yield flush()

    return common.materialise(docs.mapInArrow(run, "chunk long, docs long, tokens long"), f"{folder}/chunks")


class Chunk:
    """The tokens of a chunk: local words (their keys ascend), and after the first level's answers their ids and counts."""

    def __init__(self, folder: str, chunk: int):
        z = _load(f"{folder}/tokens/{chunk}.npz")
        self.folder, self.chunk, self.words, self.size, self.train = folder, chunk, int(z["words"]), z["size"], z["train"]
        self.doc = [int(d) if k else None for d, k in zip(z["doc"], z["known"])]
        self.index = _unpack(z["index"], np.arange(int(self.size.sum())), int(z["width"])).astype(np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.trained = np.repeat(self.train, self.size)

    def keys(self) -> np.ndarray:
        return EliasFano.from_buffer(store.mapped(f"{self.folder}/keys/{self.chunk}.bin"))[0].decode()

    def named(self, model: Model, answers: list) -> None:
        """ids and counts of the local words; a last one stands for all unknown words, one more for the begin of a text."""
        n, words = self.words, model.words
        files = np.repeat([r[0] for r in answers], [r[1] for r in answers]).astype(np.int64)
        at, self.counts = _answered_places(answers, files), _answered_counts(answers, files)
        ids = np.where(at >= 0, at + model.bases[0][files], -1)
        self.ids = np.concatenate([ids, [words, words]])
        self.word = np.where(ids[self.index] >= 0, self.index, n)
        self.before = np.concatenate([[n + 1], self.word[:-1]])
        self.before[self.starts] = n + 1

    def pairs(self) -> None:
        """Distinct (context, word) of local words with a known context; `pair` has each token's, -1 without one."""
        low = (self.words + 2).bit_length()
        ask = np.flatnonzero(self.before != self.words)
        found, back = grouped(self.before[ask] << low | self.word[ask])
        self.pair = np.full(len(self.word), -1)
        self.pair[ask] = back
        self.pair_context, self.pair_word = self.ids[found >> low], self.ids[found & ((1 << low) - 1)]
        self.pair_count = np.bincount(back[self.trained[ask]], minlength=len(found))

    def paired(self, model: Model, answers: list) -> None:
        """Take up level two's answers: the pairs' codes, if they are there, and their triples."""
        files, _ = model.layouts[0].place(self.pair_context, self.pair_word)
        at = _answered_places(answers, files)
        if all(r[3] is not None for r in answers):
            alpha, beta = _answered_codes(answers, files)
            self.pair_codes = alpha, _spread(model, 2, self.pair_context, beta)
        self.triples(np.where(at >= 0, at + model.bases[1][files], -1))

    def triples(self, entry: np.ndarray) -> None:
        """Distinct (pair, word) whose pair has an entry of level two; `triple` has each token's, -1 without one."""
        low = (self.words + 2).bit_length()
        before = np.concatenate([[-1], self.pair[:-1]])
        before[self.starts] = -1
        ask = np.flatnonzero(before >= 0)
        ask = ask[entry[before[ask]] >= 0]
        found, back = grouped(before[ask] << low | self.word[ask])
        self.triple = np.full(len(self.word), -1)
        self.triple[ask] = back
        self.triple_context, self.triple_word = entry[found >> low], self.ids[found & ((1 << low) - 1)]
        self.triple_count = np.bincount(back[self.trained[ask]], minlength=len(found))


def _rows_of(pdf: pd.DataFrame) -> list[tuple]:
    """(file, number of keys, places, what else is known or None) of a chunk's answers, by file."""
    got = pdf[pdf["file"] >= 0].sort_values("file")
    return list(zip(got["file"].tolist(), got["n"].tolist(), got["a"].tolist(), got["x"].tolist() if "x" in got else [None] * len(got)))


def _in_order(parts: list[np.ndarray], files: np.ndarray) -> np.ndarray:
    """Numbers of answers in the order in which the keys went out to `files`."""
    out = np.zeros(len(files), np.int64)
    if parts:
        out[_order(files)] = np.concatenate(parts)
    return out


def _answered_places(rows: list, files: np.ndarray) -> np.ndarray:
    return _in_order([_places(_unnumbers(r[2], r[1])) for r in rows], files)


def _answered_counts(rows: list, files: np.ndarray) -> np.ndarray:
    return _in_order([_unnumbers(r[3], r[1]) for r in rows], files)


def _answered_codes(rows: list, files: np.ndarray) -> list[np.ndarray]:
    parts = [_uncodes(r[3], r[1]) for r in rows]
    return [_in_order([p[k] for p in parts], files) for k in (0, 1)]


def _put(uri: str, rows: list) -> None:
    """Keep answers as they came."""
    heads = np.array([[f, n, len(a), len(x)] for f, n, a, x in rows], "<i8").reshape(-1, 4)
    store.write_atomic(uri, heads.tobytes(), *[part for r in rows for part in r[2:]], np.array([len(rows)], "<i8").tobytes())


def _get(uri: str) -> list:
    buf = bytes(store.mapped(uri))
    heads = np.frombuffer(buf, "<i8", 4 * int(np.frombuffer(buf[-8:], "<i8")[0])).reshape(-1, 4)
    at, out = heads.nbytes, []
    for f, n, a, x in heads.tolist():
        out.append((f, n, buf[at : at + a], buf[at + a : at + a + x]))
        at += a + x
    return out


def _spread(model: Model, level: int, contexts: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Back-off codes with those of spread contexts put in."""
    for h, code in model.backoff[level - 2].items():
        beta = np.where(contexts == h, code, beta)
    return beta


# the whole ----------------------------------------------------------------------------------


def _tasks(n: int) -> int:
    """How many tasks share n shards or chunks."""
    return max(1, min(n, MOST_TASKS))


def _packed(at: np.ndarray, counts: np.ndarray) -> bytes:
    return np.stack([at, counts]).astype("<i8").tobytes()


def _run(docs: DataFrame, folder: str, model: Model | None, discount: float, shard_bytes: int, chunk_tokens: int):
    """(model, answers of the last level, chunk list) for rows (doc_id, text, train); a model that is given is looked up, not built."""
    spark = docs.sparkSession
    built = model is None
    size = docs.filter("train").agg(F.sum(F.octet_length("text"))).first()[0] or 0 if built else 0
    chunks = cut(docs, folder, chunk_tokens)
    n_chunks, n_docs, total = chunks.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if built:
        model = Model(folder, max(0, size // shard_bytes).bit_length(), total, discount)
    bits, share = model.bits, model.share
    stub = chunks.select("chunk", F.lit(-1).alias("file"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("a"), F.lit(b"").alias("x"))

    def words_out(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                it = Chunk(folder, c)
                keys, counts = it.keys(), np.bincount(it.index[it.trained], minlength=it.words)
                yield pa.RecordBatch.from_pandas(blobs(c, keys >> (63 - bits), keys, counts), preserve_index=False)

    def word_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        f = int(pdf["file"].iloc[0])
        asked, keys, counts = merged(pdf)
        own, seen = keys[counts > 0], counts[counts > 0]
        if built:
            store.write_atomic(made.path(1, f), Words.encode(own, seen))
        level, hot = Words(store.mapped(made.path(1, f)) if built or made.bases[0][f + 1] > made.bases[0][f] else Words.encode(keys[:0], counts[:0])), np.flatnonzero(seen > share)
        rows = [(-1, f, len(own), _packed(hot, seen[hot]), b"")]
        at, n = level.find(keys)
        for c, k in zip(pdf["chunk"], asked):
            rows.append((c, f, len(k), _numbers(_steps(at[k])), _numbers(n[k])))
        return pd.DataFrame(rows, columns=["chunk", "file", "n", "a", "x"])

    def ended(answers: DataFrame, level: int, files: int) -> dict[int, int]:
        """Take up a finished level's sizes; returns its frequent entries."""
        if not built:
            return {}
        bases, heavy = model.sized(files, answers.filter("chunk < 0").select("file", "n", "a").collect())  # a row a file
        model.bases.append(bases)
        if level > 1:
            layout, codes = model.layouts[level - 2], {}
            for h, first, n in zip(layout.hot.tolist(), layout.first.tolist(), layout.spread.tolist()):
                types = int(bases[first + n] - bases[first])
                codes[h] = int(quantise(np.array([discount * types / max(1, layout.heavy[h])]))[0])
            model.backoff.append(codes)
        return heavy

    def by_chunk(answers: DataFrame, *parts: str) -> DataFrame:
        names = ["chunk", "file", "n", *parts]
        return answers.filter("chunk >= 0").select(*names).unionByName(stub.select(*names)).repartition(_tasks(n_chunks), "chunk").groupBy("chunk")

    def by_file(sent: DataFrame, files: int) -> DataFrame:
        return sent.repartition(_tasks(files), "file").groupBy("file")

    def level_shard(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            f = int(pdf["file"].iloc[0])
            layout = made.layouts[level - 2]
            asked, keys, counts = merged(pdf)
            contexts, context, word, whole = layout.split(f, keys)
            own = np.flatnonzero(counts > 0)
            if built:
                store.write_atomic(made.path(level, f), Level.encode(contexts, context[own], word[own], counts[own], discount, whole))
            have = built or made.bases[level - 1][f + 1] > made.bases[level - 1][f]
            hot = np.flatnonzero(counts[own] > share)
            rows = [(-1, f, len(own), _packed(hot, counts[own[hot]]), b"")]
            at, alpha, beta = Level(store.mapped(made.path(level, f))).find(context, word) if have else (np.full(len(keys), -1), np.full(len(keys), ZERO), np.full(len(keys), ZERO))
            for c, k in zip(pdf["chunk"], asked):
                rows.append((c, f, len(k), _numbers(_steps(at[k])) if level == 2 else b"", _codes(alpha[k], beta[k])))
            return pd.DataFrame(rows, columns=["chunk", "file", "n", "a", "x"])

        return run

    def pairs_out(pdf: pd.DataFrame) -> pd.DataFrame:
        it, rows = Chunk(folder, int(pdf["chunk"].iloc[0])), _rows_of(pdf)
        _put(f"{folder}/words/{it.chunk}.bin", rows)
        it.named(made, rows)
        it.pairs()
        return blobs(it.chunk, *made.layouts[0].place(it.pair_context, it.pair_word), it.pair_count)

    def triples_out(pdf: pd.DataFrame) -> pd.DataFrame:
        it, rows = Chunk(folder, int(pdf["chunk"].iloc[0])), _rows_of(pdf)
        it.named(made, _get(f"{folder}/words/{it.chunk}.bin"))
        it.pairs()
        it.paired(made, rows)
        return blobs(it.chunk, *made.layouts[1].place(it.triple_context, it.triple_word), it.triple_count)

    files, made = 1 << bits, model
    sent = chunks.select("chunk").repartition(_tasks(n_chunks)).mapInArrow(words_out, BLOBS)
    answers = common.materialise(by_file(sent, files).applyInPandas(word_shard, ANSWERS), f"{folder}/answers-1")
    for level, out, parts in ((2, pairs_out, "ax"), (3, triples_out, "a")):
        heavy = ended(answers, level - 1, files)
        if built:
            if level == 2:
                model.words = int(model.bases[0][-1])
                heavy[model.words] = n_docs
            model.layouts.append(Layout(model.bases[level - 2], model.words + 1, heavy, share))
        files = model.layouts[level - 2].files
        answers = common.materialise(by_file(by_chunk(answers, *parts).applyInPandas(out, BLOBS), files).applyInPandas(level_shard(level), ANSWERS), f"{folder}/answers-{level}")
        if level == 2:
            for path in ("answers-1", "keys"):
                common.remove(spark, f"{folder}/{path}")
            pairs = answers
        common.let_go(spark)
    ended(answers, 3, files)
    both = pairs.withColumn("level", F.lit(2)).unionByName(answers.withColumn("level", F.lit(3))).filter("chunk >= 0")
    both = both.select("level", "chunk", "file", "n", "a", "x").unionByName(stub.withColumn("level", F.lit(3)))
    return model, both.repartition(_tasks(n_chunks), "chunk").groupBy("chunk")


def _rows(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))


def train_and_score(docs: DataFrame, train: Column, folder: str, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES, chunk_tokens: int = CHUNK_TOKENS) -> tuple[Model, DataFrame]:
    """The model of the documents where `train` is true, and the scores of all: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    return _scored(*_run(_rows(docs, train), folder, None, discount, shard_bytes, chunk_tokens), folder)


def train(docs: DataFrame, folder: str, **how) -> Model:
    """The model of all documents given."""
    return train_and_score(docs, F.lit(True), folder, **how)[0]


def score(docs: DataFrame, model: Model, folder: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Scores of documents by a model that exists; `folder` takes the chunks."""
    return _scored(*_run(_rows(docs, F.lit(False)), folder, model, model.discount, SHARD_BYTES, chunk_tokens), folder)[1]


def _scored(model: Model, answers, folder: str) -> tuple[Model, DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        it = Chunk(folder, int(pdf["chunk"].iloc[0]))
        it.named(model, _get(f"{folder}/words/{it.chunk}.bin"))
        it.pairs()
        it.paired(model, _rows_of(pdf[pdf["level"] == 2]))
        alpha, beta = _answered_codes(_rows_of(pdf[pdf["level"] == 3]), model.layouts[1].place(it.triple_context, it.triple_word)[0])
        codes3 = alpha, _spread(model, 3, it.triple_context, beta)
        single = model.unigram(it.counts)
        p, base = single[it.index], np.log10(single)[it.index]
        for which, (alpha, beta) in ((it.pair, it.pair_codes), (it.triple, codes3)):
            ask = np.flatnonzero(which >= 0)
            a, b, of = VALUES[alpha], np.where(beta == ZERO, 1.0, VALUES[beta]), which[ask]
            p[ask] = a[of] + b[of] * p[ask]
        add = lambda x: np.add.reduceat(x, it.starts)
        known = add((it.counts > 0)[it.index].astype(np.int64))
        return pd.DataFrame({"doc_id": pd.array(it.doc, "Int64"), "n_tokens": it.size, "n_known": known, "train_tokens": model.total, "base_score": add(base), "score": add(np.log10(p))})

    return model, answers.applyInPandas(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
