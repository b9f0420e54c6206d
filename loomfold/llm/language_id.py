"""Language identification by compression.

For each language a zstandard dictionary of raw content is made from distinct pieces of texts of that language. A text is
cut into blocks, each block is compressed with each dictionary, and the language whose dictionary
gives the fewest bytes in all is chosen. Where the runner-up comes too close, the choice is marked as
rejected.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_text, lean, pinned, released, texts_of

BLOCK = 4096
#: How every text is compressed, whatever its length: matches of three bytes and more, taken greedily, anywhere in a dictionary.
PARAMETERS = {"strategy": 3, "min_match": 3, "window_log": 18, "hash_log": 17, "chain_log": 16, "search_log": 4, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-cased letters with one space for all that stands between them: what a language shows in."""
    return _OTHER.sub(" ", text.lower()).encode()


def has_letter(text: str) -> bool:
    """Whether a character of text is of a category of letters; number signs such as a half are not."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


#: The compressors of the classifier that a worker used last, so that its next task doesn't prepare them again.
_PREPARED: dict[tuple, list] = {}


def prepared(contents: dict[str, bytes]) -> list:
    """A compressor for each dictionary."""
    import zstandard as zstd

    how, out = zstd.ZstdCompressionParameters(**PARAMETERS), []
    for content in contents.values():
        raw = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=how)
        out.append(zstd.ZstdCompressor(dict_data=raw, compression_params=how))
    return out


class CompressionClassifier:
    """Dictionaries by language, the likeliest first, which wins ties; picklable, compressors are made where they are used."""

    def __init__(self, contents: dict[str, bytes], margin: float = 0.01, steepness: float = 60.0):
        self.contents, self.margin, self.steepness = dict(contents), margin, steepness
        self._engines = None

    def __getstate__(self):
        return self.__dict__ | {"_engines": None}

    def engines(self) -> list:
        if self._engines is None:
            key = tuple((lang, len(c), xxhash.xxh3_128_digest(c)) for lang, c in self.contents.items())
            if key not in _PREPARED:
                _PREPARED.clear()
                _PREPARED[key] = prepared(self.contents)
            self._engines = _PREPARED[key]
        return self._engines

    def sizes(self, letters: bytes) -> list[int]:
        """Compressed bytes of the whole text by language."""
        blocks = [letters[i : i + BLOCK] for i in range(0, len(letters), BLOCK)]
        return [sum(len(engine.compress(b)) for b in blocks) for engine in self.engines()]

    def classify(self, text: bytes) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the margin to the runner-up on a scale from 0 to 1; with one language it is 1."""
        letters = text.decode()
        if not self.contents or not has_letter(letters):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(plain(letters))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = list(self.contents)[order[0]]
        if len(order) == 1:
            return best, 1.0, False
        margin = 1 - sizes[order[0]] / sizes[order[1]]
        return best, 1 - math.exp(-self.steepness * margin), margin < self.margin


#: A piece ends at a word of which the hash has these bits unset, and after so many words or bytes of a word.
PIECE_BITS, PIECE_WORDS, PIECE_BYTES = 15, 64, 256
#: Texts that a task remembers, so as to cut copies into pieces once; languages up to which their few numbers are broadcast.
SEEN_TEXTS, BROADCAST_LANGUAGES = 100_000, 100_000
#: Bytes that a dictionary has to have.
LEAST_BYTES = 8


def pieces(letters: bytes) -> Iterator[bytes]:
    """Runs of about sixteen words that cover all of a plain text; where they end depends on the words, so passages that texts share give the same pieces."""
    words, start = letters.split(), 0
    for i, word in enumerate(words):
        if not zlib.crc32(word) & PIECE_BITS or i - start + 1 == PIECE_WORDS or len(word) > PIECE_BYTES or i + 1 == len(words):
            piece, start = b" ".join(words[start : i + 1]), i + 1
            if len(word) > PIECE_BYTES:
                yield from (piece[j : j + PIECE_BYTES] for j in range(0, len(piece), PIECE_BYTES))
            else:
                yield piece


def piece_hash(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) >> 1


def lowest(found: dict[int, bytes], most_bytes: int) -> dict[int, bytes]:
    """The pieces of the lowest hashes, up to the one that makes up ``most_bytes``."""
    out, size = {}, 0
    for h in sorted(found):
        if size >= most_bytes:
            break
        out[h] = found[h]
        size += len(found[h]) + 1
    return out


def fit(docs: DataFrame, sample_docs: int = 10_000, dictionary_bytes: int = 192 << 10, all_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0, **kwargs) -> CompressionClassifier:
    """A classifier from the texts and languages of docs; rows without language or text are left out, ids are not read.

    The sample is bounded: about ``sample_docs`` distinct texts a language, drawn by a hash of the text,
    and of their pieces those of the lowest hashes, ``dictionary_bytes`` a language. Where languages are so many that
    their dictionaries would have more than ``all_bytes`` together, which is what the driver and every worker hold, each has an
    equal share of that; no language is left out. Pieces come from
    anywhere in a text, and each counts once: neither copies, near copies nor a passage that texts share
    take more room than one of it. Pieces that several languages have say nothing of the language and
    are left out, unless a language has little else. A text gives at most 16 pieces, or more where texts
    are few. Of texts that repeat with several languages each language learns.
    """
    rows = docs.select(docs[text_col].alias("text"), docs[lang_col].alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL").withColumn("hash", F.xxhash64("text", F.lit(seed)))
    counted = pinned(rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    room = min(dictionary_bytes, all_bytes // max(1, counted.count()))
    # Of a language: the share of its texts that are drawn, and the pieces that a text gives at most.
    shares = counted.select("lang", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")).alias("chance"), F.greatest(F.lit(16), F.ceil(F.lit(room) / (8 * F.least("n", F.lit(sample_docs))))).cast("int").alias("each"))
    drawn = rows.join(bounded(shares, BROADCAST_LANGUAGES), "lang").where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < F.col("chance")).select("text", "lang", "hash", "each")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            found: dict[tuple[int, str], bytes] = {}
            for text, lang, h, each in zip(texts_of(batch.column(0)), *[batch.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                if (lang, h) in seen:
                    continue
                if len(seen) >= SEEN_TEXTS:
                    seen.clear()
                seen.add((lang, h))
                own = {piece_hash(x): x for x in pieces(plain(text.decode()))}
                found.update({(k, lang): own[k] for k in heapq.nsmallest(each, own)})
            yield pa.RecordBatch.from_arrays([pa.array([k for _, k in found], pa.string()), pa.array([k for k, _ in found], pa.int64()), pa.array(list(found.values()), pa.binary())], ["lang", "hash", "piece"])

    distinct = drawn.mapInArrow(lean(run), "lang string, hash bigint, piece binary").groupBy("hash").agg(F.collect_set("lang").alias("langs"), F.min("piece").alias("piece"))
    merged = pinned(distinct)
    found = merged.select(F.explode("langs").alias("lang"), "hash", "piece", (F.size("langs") == 1).alias("own"))
    size = F.octet_length("piece") + 1
    of_own = F.coalesce(F.sum(F.when(F.col("own"), size)), F.lit(0))
    # Whether shared pieces are left out, and the share of hashes that fills a dictionary; a fifth more comes to the driver, which takes the lowest.
    apart = (2 * F.col("own_bytes") >= F.col("whole_bytes")) | (F.col("own_bytes") >= room)
    most = found.groupBy("lang").agg(of_own.alias("own_bytes"), F.sum(size).alias("whole_bytes")).select("lang", apart.alias("apart"), F.least(F.lit(1.0), F.lit(1.2 * room) / F.when(apart, F.col("own_bytes")).otherwise(F.col("whole_bytes"))).alias("most"))
    taken: dict[str, dict[int, bytes]] = {}
    kept = found.join(bounded(most, BROADCAST_LANGUAGES), "lang").where((F.col("own") | ~F.col("apart")) & (F.col("hash") / float(1 << 63) <= F.col("most")))
    for r in kept.select("lang", "hash", "piece").toLocalIterator():
        taken.setdefault(r["lang"], {})[r["hash"]] = bytes(r["piece"])
    often = {r["lang"]: r["n"] for r in counted.collect()} if taken else {}
    released(merged)
    released(counted)
    contents = {lang: b"\n".join(lowest(taken[lang], room).values())[:room] for lang in sorted(taken, key=lambda x: (-often[x], x))}
    # A dictionary has eight bytes at least; shorter ones are repeated, so that the language stays.
    return CompressionClassifier({k: v if len(v) >= LEAST_BYTES else (v + b"\n") * LEAST_BYTES for k, v in contents.items() if v}, **kwargs)


def identify(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, lang_pred, score, rejected.

    Whole texts are compressed. ``lang_pred`` is the best language even where the choice is rejected
    for a narrow margin, and ``und`` (score 0, rejected) for a text that is null or has no letter.
    Of languages that give the same size, that with more texts wins, then that of the lesser name.
    Equal texts get equal results. Null and repeated ids are kept as they are. An empty table gives an empty
    result; other columns of docs are not read, whatever their names.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.classify(t) for t in texts_of(batch.column(1))]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.float64(), pa.bool_()], strict=True)]], [id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")
