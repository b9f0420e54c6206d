"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that no vocabulary token contains can't be merged over, so a cut
between the two is certain. Where such a cut is also one that can't change how the pre-tokenizer
reads either side, the text is cut; fragments are encoded by themselves, each distinct one once, and
their ids are concatenated. The result is that of the ``tokenizers`` library on the whole text.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, lean, texts_of

#: Fixed value: how byte-level BPE splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are cut in one go, and what the cache of fragments may hold.
SLAB_BYTES, CACHE_FRAGMENTS, CACHED_BYTES = 4 << 20, 150_000, 96
#: Bytes up to which a fragment goes to the faster library: its regular expressions recurse over white space.
FAST_BYTES = 4096
#: Characters that every version of Unicode classes alike, so that two regular-expression engines split them alike.
SETTLED = re.compile(r"[\x00-\x7f\u00c0-\u024f]*")


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Fragments(dict):
    """Ids of fragments as bytes, encoded when they are first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = array.array("I", self.encode(fragment.decode())).tobytes()
        if len(fragment) <= CACHED_BYTES:
            if len(self) >= CACHE_FRAGMENTS:
                self.clear()
            self[fragment] = ids
        return ids


class ForcedBoundaryBPE:
    """Encoder and decoder for a byte-level BPE file of the ``tokenizers`` library without normalizer or prefix space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        pre = described["pre_tokenizer"]
        if described["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"]):
            raise ValueError("cuts are certain only for byte-level BPE without normalizer, prefix space or stripping added tokens")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        stand_ins = byte_of_character()
        self.bytes_of = {i: bytes(stand_ins[c] for c in token) for token, i in described["model"]["vocab"].items()}
        inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            for pair in zip(token, token[1:]):
                inside[pair] = True
        self.added = sorted(((t["content"].encode(), t["id"]) for t in described["added_tokens"]), key=lambda x: -len(x[0]))
        if any(a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, len(b)))) for a, _ in self.added for b, _ in self.added):
            raise ValueError("added tokens that overlap are found in an order of the library's own")
        self.bytes_of |= {i: content for content, i in self.added}
        self.cut_between = (~inside & self.harmless()).reshape(-1)
        self.may_end_space = self.space_ends().reshape(-1)
        self.cache = Fragments(self.fragment_encoder(described))

    def fragment_encoder(self, described: dict):
        """From a fragment to its ids: by the faster library where the vocabulary's ids are in the order of merges, else by ``tokenizers``."""
        slow = lambda text: self.library.encode(text, add_special_tokens=False).ids
        vocab, merges = described["model"]["vocab"], described["model"]["merges"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        if [vocab.get(m) for m in merged] != [*range(len(vocab) - len(merged), len(vocab))] or sys.byteorder != "little":
            return slow
        import tiktoken

        fast = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks={self.bytes_of[i]: i for i in vocab.values()}, special_tokens={}).encode_ordinary
        return lambda text: fast(text) if len(text) <= FAST_BYTES and SETTLED.fullmatch(text) else slow(text)

    @staticmethod
    def harmless() -> np.ndarray:
        """Pairs (left, right) of bytes between which a cut leaves the pre-tokenizer's reading as it is.

        The right byte has to begin a character. White space on the left is out, since how a run of
        it splits depends on what follows. An apostrophe on the right could turn into a contraction
        that it isn't in the whole text, unless a letter or digit stands before it.
        """
        ok = np.ones((256, 256), bool)
        ok[:, 0x80:0xC0] = False
        ok[[*range(0x09, 0x0E), *range(0x1C, 0x21)], :] = False
        alnum = [b for b in range(128) if chr(b).isalnum()]
        ok[[b for b in range(256) if b not in alnum], 0x27] = False
        return ok

    @staticmethod
    def space_ends() -> np.ndarray:
        """Pairs of bytes that a white-space character beyond ASCII may end with."""
        ends = np.zeros((256, 256), bool)
        ends[0xC2, [0x85, 0xA0]] = True
        ends[0x9A, 0x80] = True
        ends[0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]] = True
        ends[0x81, 0x9F] = True
        return ends

    def cuts(self, text: bytes) -> np.ndarray:
        """The positions at which text may be cut."""
        b = np.frombuffer(text, np.uint8).astype(np.int32)
        pairs = b[:-1] << 8 | b[1:]
        cut = self.cut_between[pairs]
        cut[1:] &= ~self.may_end_space[pairs[:-1]]
        return np.flatnonzero(cut) + 1

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        for content, i in self.added:
            if content in text:
                return np.array([i], "<u4").tobytes().join(self.encode(part) for part in text.split(content))
        out = []
        start, end = 0, len(text)
        while start < end:
            stop = min(end, start + SLAB_BYTES)
            slab = text[start:stop]
            cuts = self.cuts(slab) if len(slab) > 1 else np.zeros(0, np.int64)
            while stop < end and not len(cuts):  # no certain cut in the whole slab: look further
                stop = min(end, stop + stop - start)  # twice as far each time, so that all of it is looked at twice at most
                slab = text[start:stop]
                cuts = self.cuts(slab)
            if stop < end:
                slab, cuts, stop = slab[: cuts[-1]], cuts[:-1], start + int(cuts[-1])
            at = cuts.tolist()
            out += map(self.cache.__getitem__, [slab[i:j] for i, j in zip([0, *at], [*at, len(slab)], strict=True)])
            start = stop
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 of the text that the ids stand for, special tokens included."""
        out = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode(errors="replace").encode()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids (binary, little-endian unsigned 32-bit).

    Null text counts as empty and gives no ids. The strings of added tokens become those tokens, as
    in the library. ``path`` names the tokenizer file on every executor. Texts of any length are cut
    in slabs at certain cuts. Other columns are not read; an empty table gives an empty result.
    """
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [id_col, "n_tokens", "ids"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: id_col, n_tokens, ids, text. Null ids count as none."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            ids = texts_of(batch.column(1))
            texts = pa.array([bpe.decode(x) for x in ids], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), texts], [id_col, "n_tokens", "ids", "text"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids binary, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of each row, encoded and decoded in one pass."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            n, coded, decoded = [], [], []
            for text in texts_of(batch.column(1)):
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_and_verify(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` with ``round_trip``: whether the ids decode to the text."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            ids = [bpe.encode(t) for t in texts]
            same = [bpe.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], [id_col, "n_tokens", "ids", "round_trip"])

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens bigint, ids binary, round_trip boolean")
