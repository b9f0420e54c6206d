"""SentencePiece BPE in vectorised merge rounds.

A text is normalised as the model says and cut where two neighbouring characters occur side by side in
no piece: nothing is ever merged over such a place. What stands between cuts is a word here. All words
of a batch that aren't known yet lie one after the other in flat arrays of symbols. A round finds the
least rank of a pair in every word, merges the pairs of that rank in each word from the left, as far
as the order of the queue that merges one pair at a time allows, and closes the gaps; words without a
pair leave the arrays. The ids are those of the ``sentencepiece`` library on the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, lean, texts_of

#: The sign that stands for a space in pieces, and the kinds of pieces in a model file.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What the cache of words may hold; symbols up to which a word goes into the rounds; symbols that go into them together; characters of a text cut in one go;
#: words that wait for each other's ids.
CACHE_WORDS, CACHED_CHARS, LONG_WORD, ROUND_SYMBOLS, SLAB_CHARS, WAITING_WORDS = 150_000, 48, 512, 1 << 18, 1 << 20, 200_000
_NONE = np.int32(np.iinfo(np.int32).max)
_POINTS = 0x110000


class PieceBPE:
    """Encoder and decoder for a BPE model file of the ``sentencepiece`` library with byte fallback and the identity as normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trained, normal = model.trainer_spec, model.normalizer_spec
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are read")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only the identity is known as normaliser")
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        scores = sorted({-model.pieces[i].score for i in pieces.values()})
        place = {s: r for r, s in enumerate(scores)}
        self.byte_ids = np.zeros(256, "<u4")
        surface = [b""] * len(model.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], surface[i] = i, bytes([value])
            elif p.type != CONTROL:
                surface[i] = trained.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode()
        self.surface, self.byte_set = surface, frozenset(self.byte_ids.tolist())
        # Symbols: ids of pieces, and further numbers for characters that are in pieces without being one.
        inner = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.n_ids = len(model.pieces)
        self.loose = [c for c in inner if c not in pieces]
        symbol_of = pieces | {c: self.n_ids + k for k, c in enumerate(self.loose)}
        self.symbol_of_point = np.full(_POINTS, -1, np.int32)
        for c, s in symbol_of.items():
            if len(c) == 1:
                self.symbol_of_point[ord(c)] = s
        self.width = np.int64(self.n_ids + len(self.loose))
        # Pairs of characters inside pieces: between any others a cut is certain.
        letter = {c: k + 1 for k, c in enumerate(inner)}
        self.letter_of_point = np.zeros(_POINTS, np.uint16)
        self.letter_of_point[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.inside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        merges: dict[int, tuple[int, int]] = {}
        for piece, i in pieces.items():
            rank = place[-model.pieces[i].score]
            for k in range(1, len(piece)):
                self.inside[letter[piece[k - 1]], letter[piece[k]]] = True
                left, right = symbol_of.get(piece[:k]), symbol_of.get(piece[k:])
                if left is not None and right is not None:
                    merges[left * int(self.width) + right] = (i, rank)
        self.keys = np.array(sorted(merges), np.int64)
        self.made = np.array([merges[k][0] for k in self.keys.tolist()] + [0], np.int32)
        self.rank = np.array([merges[k][1] for k in self.keys.tolist()] + [int(_NONE)], np.int32)
        self.by_pair = merges
        self.cache: dict[str, bytes] = {}

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair of symbols stands in the table of merges; its last row stands for pairs that don't merge."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return at

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text that isn't empty, slab by slab."""
        text = self.prefix + text.replace(" ", SPACE)
        carried = ""
        for start in range(0, len(text), SLAB_CHARS):
            slab = carried + text[start : start + SLAB_CHARS] if carried else text[start : start + SLAB_CHARS]
            letters = self.letter_of_point[np.frombuffer(slab.encode("utf-32-le", "surrogatepass"), np.uint32)]
            cuts = (np.flatnonzero(~self.inside[letters[:-1], letters[1:]]) + 1).tolist()
            found = [slab[i:j] for i, j in zip([0, *cuts], [*cuts, len(slab)], strict=True)]
            carried = found.pop() if start + SLAB_CHARS < len(text) else ""
            yield found
            if len(carried) > SLAB_CHARS:  # a word without an end in sight: what follows is one with it until a cut
                rest = text[start + SLAB_CHARS :]
                yield from self.endless(carried, rest)
                return

    def endless(self, carried: str, rest: str) -> Iterator[list[str]]:
        """The words of carried + rest, looked at once as a whole."""
        whole = carried + rest
        letters = self.letter_of_point[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cuts = (np.flatnonzero(~self.inside[letters[:-1], letters[1:]]) + 1).tolist()
        yield [whole[i:j] for i, j in zip([0, *cuts], [*cuts, len(whole)], strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; words that are new are merged together."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            for words in self.words(text) if text else ():
                waiting.append((i, words))
                size += len(words)
                if size >= WAITING_WORDS:
                    self.settle(waiting, out)
                    waiting, size = [], 0
        self.settle(waiting, out)
        return [b"".join(parts) for parts in out]

    def settle(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        """Joins the ids of the words that wait to those of their texts."""
        known = self.learn(set().union(*[words for _, words in waiting]))
        for i, words in waiting:
            out[i].append(b"".join(map(known.__getitem__, words)))

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """A dictionary that has the ids of all these words: the cache, with long words beside it."""
        new = [w for w in words if w not in self.cache]
        if not new:
            return self.cache
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        solved = self.solve(new)
        self.cache.update((w, ids) for w, ids in solved.items() if len(w) <= CACHED_CHARS)
        return self.cache if all(len(w) <= CACHED_CHARS for w in new) else self.cache | solved

    def solve(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, in rounds over as many words as fit ``ROUND_SYMBOLS``; longer ones by themselves."""
        out: dict[str, bytes] = {}
        together: list[str] = []
        size = 0
        for word in words:
            if len(word) == 1:
                alone = int(self.symbol_of_point[ord(word)])
                out[word] = self.ids_of([alone]) if alone >= 0 else self.byte_ids[list(word.encode("utf-8", "replace"))].tobytes()
            elif len(word) > LONG_WORD:
                out[word] = self.ids_of(self.one_by_one(word))
            else:
                if together and size + len(word) > ROUND_SYMBOLS:
                    out.update(self.rounds(together))
                    together, size = [], 0
                together.append(word)
                size += len(word)
        if together:
            out.update(self.rounds(together))
        return out

    def ids_of(self, symbols: list[int]) -> bytes:
        """Ids of symbols; a character that is no piece gives the ids of its bytes."""
        if not self.loose or max(symbols) < self.n_ids:
            return np.array(symbols, "<u4").tobytes()
        return b"".join(np.array([s], "<u4").tobytes() if s < self.n_ids else self.byte_ids[list(self.loose[s - self.n_ids].encode())].tobytes() for s in symbols)

    def rounds(self, words: list[str]) -> dict[str, bytes]:
        """All words at once: a round merges in each word the pairs of its least rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.symbol_of_point[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        while len(symbol):
            at = np.full(len(symbol), len(self.keys))
            same = word[:-1] == word[1:]
            at[:-1][same] = self.pairs(symbol[:-1][same], symbol[1:][same])
            rank = self.rank[at]
            starts = np.flatnonzero(np.r_[True, ~same])
            spans = np.diff(np.r_[starts, len(symbol)])
            least = np.repeat(np.minimum.reduceat(rank, starts), spans)
            ended = least == _NONE
            if ended.any():
                done_symbols.append(symbol[ended])
                done_words.append(word[ended])
                symbol, word, at, rank, least = (x[~ended] for x in (symbol, word, at, rank, least))
                if not len(symbol):
                    break
            place = np.flatnonzero(rank == least)
            # Of pairs that overlap every second one, from the left.
            fresh = np.r_[True, place[1:] != place[:-1] + 1]
            nth = np.arange(len(place))
            place = place[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            place = place[self.in_turn(symbol, word, at, rank, place)]
            symbol[place] = self.made[at[place]]
            keep = np.ones(len(symbol), bool)
            keep[place + 1] = False
            symbol, word = symbol[keep], word[keep]
        symbol, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        symbol = symbol[order]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        if self.loose:
            return {w: self.ids_of(symbol[i:j].tolist()) for w, i, j in zip(words, [0, *ends[:-1]], ends, strict=True)}
        packed = symbol.astype("<u4").tobytes()
        return {w: packed[4 * i : 4 * j] for w, i, j in zip(words, [0, *ends[:-1]], ends, strict=True)}

    def in_turn(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the merges at ``place`` are due in this round.

        One pair at a time, a merge may make a pair of the same rank or a lesser one with a neighbour, and that comes before what
        stands further right. So in each word the merges from the left are due up to the first that does so.
        """
        made = self.made[at[place]].astype(np.int64)
        n = len(symbol)
        before, after = place - 1, place + 2
        left = symbol[np.maximum(before, 0)].copy()
        follows = np.r_[False, place[1:] == place[:-1] + 2]
        left[follows] = made[:-1][follows[1:]]
        has_left = (before >= 0) & (word[np.maximum(before, 0)] == word[place])
        has_right = (after < n) & (word[np.minimum(after, n - 1)] == word[place])
        limit = rank[place]
        loud = np.zeros(len(place), bool)
        loud[has_left] = self.rank[self.pairs(left[has_left], made[has_left])] <= limit[has_left]
        loud[has_right] |= self.rank[self.pairs(made[has_right], symbol[after[has_right]])] <= limit[has_right]
        heard = np.cumsum(loud) - loud
        own = word[place]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return heard == np.repeat(heard[first], np.diff(np.r_[first, len(own)]))

    def one_by_one(self, word: str) -> list[int]:
        """The symbols of one very long word, merged by a queue of its pairs in n log n steps."""
        symbol = self.symbol_of_point[np.frombuffer(word.encode("utf-32-le"), np.uint32)].astype(np.int64)
        n, by_pair, width = len(symbol), self.by_pair, int(self.width)
        at = self.pairs(symbol[:-1], symbol[1:])
        some = np.flatnonzero(at < len(self.keys))
        # Rank, place, and the two symbols that have to be there still.
        queue = list(zip(self.rank[at[some]].tolist(), some.tolist(), symbol[some].tolist(), symbol[some + 1].tolist(), strict=True))
        heapq.heapify(queue)
        symbol, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            made, k = by_pair[a * width + b][0], after[j]
            symbol[i], symbol[j], after[i] = made, -1, k
            if k < n:
                before[k] = i
                if found := by_pair.get(made * width + symbol[k]):
                    heapq.heappush(queue, (found[1], i, made, symbol[k]))
            h = before[i]
            if h >= 0 and (found := by_pair.get(symbol[h] * width + made)):
                heapq.heappush(queue, (found[1], h, symbol[h], made))
        return [s for s in symbol if s >= 0]

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 of the text that the ids stand for: without the space that was put before it, and with U+FFFD for each byte that is none."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        out = b"".join(map(self.surface.__getitem__, numbers))
        if self.prefix and numbers and numbers[0] not in self.byte_set and out[:1] == b" ":
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            return one_for_each(out)
        return out


def one_for_each(data: bytes) -> bytes:
    """UTF-8 with U+FFFD for each byte that is in no character."""
    out, start = [], 0
    while start < len(data):
        try:
            data[start:].decode()
            out.append(data[start:])
            break
        except UnicodeDecodeError as e:
            out += [data[start : start + e.start], "�".encode()]
            start += e.start + 1
    return b"".join(out)


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> PieceBPE:
    """The model, once a worker."""
    return PieceBPE(path)


def strings(column: pa.Array) -> list[str]:
    return [t.decode(errors="replace") for t in texts_of(column)]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit), without begin or end ids.

    Null text counts as empty and gives no ids. ``path`` names the model file on every executor. A
    batch's new words are merged together; texts of any length are cut slab by slab, and a word of any
    length is merged in n log n steps. Equal texts get equal ids; null and repeated ids are kept. Other
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = loaded(path).encode_batch(strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id_col, n_tokens, ids, text. Null ids count as none."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = texts_of(batch.column(1))
            texts = pa.array([loaded(path).decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), texts], [id_col, "n_tokens", "ids", "text"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids binary, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 of each row, encoded and decoded in one pass."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = loaded(path)
            ids = model.encode_batch(strings(batch.column(1)))
            coded = [hashlib.sha256(",".join(map(str, np.frombuffer(x, "<u4").tolist())).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(model.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
