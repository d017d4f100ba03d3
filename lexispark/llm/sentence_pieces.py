"""SentencePiece models encoded and decoded by the tokenizers library.

The model's protobuf is parsed here, field by field. From it are rebuilt: the normaliser (character map, extra white space,
dummy prefix), the marker U+2581 for spaces, the vocabulary with a unigram model's scores or the merges that a BPE model's scores
order, byte fallback, and the decoder. No piece of the vocabularies that are split so reaches from another character into a marker, so texts are
cut before each run of markers without changing any result; a vocabulary with such a piece is not split. Cuts are found in the
bytes of an Arrow column; distinct ones are encoded once, in multithreaded batches, and kept while there are at most KEPT.

Parity: each distinct cut is also encoded by the sentencepiece library when it is first met, some of them joined to one text. The tests
hold the backend alone against the library over whole documents. Where they differ (equally scored merges of one piece may be taken in
another order) the library's ids count, and n_differ tells how many cuts of a text were so. Pass verify=False to leave this out.

A null text has null ids, n_differ and restored, an empty one no ids; an empty table gives no rows. Whole texts are encoded, however long:
beside its ids a text takes some ten bytes a character. Rows are independent: repeated rows give repeated results, a null doc_id is
carried along. Control pieces' names in a text are ordinary text. Decoding gives the normalised text; `restored` says whether that is the
text itself. Other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .util import only, ragged, steps, sums

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, THREADS, KEPT, BATCH_CHARS, GROUP, JOINED = "▁", 2, 1 << 18, 1 << 21, 1 << 11, 1 << 7
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


class Spec(NamedTuple):
    pieces: list[tuple[str, float, int]]  # text, score, type
    kind: int
    unk: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    strip_extra: bool
    escape: bool


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: numbers as int, all else as its bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                if tag & 7 != 2:
                    raise ValueError(f"wire type {tag & 7} in a model")
                size = varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse(data: bytes) -> Spec:
    pieces, trainer, normaliser = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normaliser = dict(fields(value))
    spec = Spec(pieces, trainer.get(3, UNIGRAM), trainer.get(40, 0), bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)))
    if spec.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if any(kind == UNUSED for _, _, kind in pieces) or trainer.get(24, 0) or not spec.escape:
        raise ValueError("unused pieces, white space as suffix and unescaped white space are not supported")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best score first."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    found = [(-s, len(a), a, p[len(a) :]) for p, s in score.items() for a in (p[:k] for k in range(1, len(p))) if a in score and p[len(a) :] in score]
    found.sort(key=lambda x: (x[0], x[1]))
    return [(a, b) for _, _, a, b in found]


class Backend:
    def __init__(self, data: bytes, verify: bool = True, threads: int = THREADS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.spec = spec = parse(data)
        names = [p for p, _, _ in spec.pieces]
        unk = names[spec.unk]
        if spec.kind == BPE:
            model = models.BPE({p: i for i, p in enumerate(names)}, merges(spec), unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
        else:
            # control pieces get names that no text has, and no score that would count as the least one
            least = min((s for _, s, kind in spec.pieces if kind in (NORMAL, USER)), default=0.0)
            model = models.Unigram([(p if kind != CONTROL else f"\ufdd0{i}", s if kind in (NORMAL, USER) else least) for i, (p, s, kind) in enumerate(spec.pieces)], spec.unk, spec.byte_fallback)
        chain_ = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.strip_extra:
            chain_ += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        self.before = normalizers.Sequence(chain_) if chain_ else None
        whole = [*chain_, *([normalizers.Prepend(" ")] if spec.dummy_prefix else []), normalizers.Replace(" ", MARK)]
        #: The whole model as one tokenizer, for single texts and tests.
        self.tokenizer, self.inner = Tokenizer(model), Tokenizer(model)
        self.tokenizer.normalizer = normalizers.Sequence(whole)
        user = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER]
        # a piece that reaches into a marker from another character forbids cuts; so does a marker that is no piece
        self.cuts = not user and MARK in names and not any(re.search(f"[^{MARK}]{MARK}", p) for p in names)
        if self.cuts:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        decoder = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])
        self.tokenizer.decoder = decoders.Sequence(decoder)
        if user:
            self.tokenizer.add_tokens(user)
        self.library = None
        if verify:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self._forget()
        # pieces as decoded text, None where the decoder has to look at several at once
        self.plain = ["" if kind == CONTROL else None if kind == UNKNOWN else p.replace(MARK, " ") if kind != BYTE else chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else None for p, _, kind in spec.pieces]
        self.length = np.array([-1 if p is None else len(p) for p in self.plain], np.int64)
        self.n_bytes = np.array([len(p.encode()) if kind in (NORMAL, USER) else int(kind == BYTE) for p, _, kind in spec.pieces], np.int64)
        self.control = frozenset(i for i, (_, _, kind) in enumerate(spec.pieces) if kind == CONTROL)

    def _learn(self, new: list[str]) -> None:
        """Encodes cuts not met before and adds them to the tables, a group of them as one pretokenised sequence."""
        groups = [new[i : i + GROUP] for i in range(0, len(new), GROUP)]
        size, flat = [], []
        for group, e in zip(groups, self.inner.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            ends, at = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in group]), np.cumsum(self.n_bytes[ids])
            if (self.n_bytes[ids] > 0).all() and len(at) and at[-1] == ends[-1]:
                size.append(np.diff(np.searchsorted(at, ends, "right"), prepend=0))
            else:  # unknown pieces stand for any number of bytes
                e = self.inner.encode(group, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(e.ids, np.int32)
                size.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))
            flat.append(ids)
        size, flat = np.concatenate(size), np.concatenate(flat)
        first = np.cumsum(size) - size
        differ = self._differing(new, first, size, flat) if self.library else {}
        if differ:
            parts = np.split(flat, first[1:])
            for k, theirs in differ.items():
                parts[k] = theirs
            size, flat = np.fromiter(map(len, parts), np.int64, len(parts)), np.concatenate(parts)
            first = np.cumsum(size) - size
        other = np.zeros(len(new), bool)
        other[list(differ)] = True
        known = len(self.known)
        self.known.update(zip(new, range(known, known + len(new))))
        self.lossless = np.concatenate([self.lossless, self._lossless(new, first, size, flat)])
        self.first = np.concatenate([self.first, first + len(self.flat)])
        self.flat, self.size, self.differ = np.concatenate([self.flat, flat]), np.concatenate([self.size, size]), np.concatenate([self.differ, other])

    def _differing(self, new: list[str], first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> dict[int, np.ndarray]:
        """The library's ids of the cuts for which they are others. It encodes some cuts at once as one text, and those of a text that differs one by one."""
        prefix = self.spec.dummy_prefix  # which the library adds itself
        bare = [i for i, c in enumerate(new) if c[0] != MARK or c[-1] == MARK]  # they would run into their neighbours
        alone = set(bare)
        rest = [i for i in range(len(new)) if i not in alone]
        groups = [rest[i : i + JOINED] for i in range(0, len(rest), JOINED)]
        as_text = lambda cut: cut[1:] if prefix else cut  # noqa: E731 - a marker counts as a space that is not extra
        for own, ids in zip(groups, self.library.encode([as_text("".join([new[i] for i in own])) for own in groups], num_threads=THREADS)):
            at = np.array(own, np.int64)
            mine = flat[ragged(first[at], size[at])]
            if len(mine) != len(ids) or (mine != np.array(ids, np.int32)).any():
                bare += own
        if prefix:
            bare = [i for i in bare if new[i] != MARK]  # an empty text
        out = {}
        for i, ids in zip(bare, self.library.encode([as_text(new[i]) for i in bare], num_threads=THREADS)):
            if ids != flat[first[i] : first[i] + size[i]].tolist():
                out[i] = np.array(ids, np.int32)
        return out

    def _lossless(self, new: list[str], first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Whether each cut's pieces put together are the cut. Those with bytes or unknown pieces are decoded for it."""
        odd = sums((self.length[flat] < 0).astype(np.int64), size) > 0
        out = ~odd & (sums(self.length[flat], size) == np.fromiter(map(len, new), np.int64, len(new)))
        own = np.flatnonzero(out)
        # equal lengths one by one and equal texts in all are equal texts one by one
        if "".join(map(self.plain.__getitem__, flat[ragged(first[own], size[own])].tolist())) != "".join([new[i] for i in own.tolist()]).replace(MARK, " "):
            out[:], odd[:] = False, True
        for i in np.flatnonzero(odd).tolist():
            text = self.tokenizer.decode(flat[first[i] : first[i] + size[i]].tolist(), skip_special_tokens=False)
            out[i] = (" " if self.spec.dummy_prefix else "") + text == new[i].replace(MARK, " ")  # the decoder takes the prefix away
        return out

    def _forget(self) -> None:
        e = np.zeros(0, np.int64)
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = e, e, e.astype(np.int32)
        self.differ, self.lossless = e.astype(bool), e.astype(bool)

    def encode_column(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids of each text; how many cuts of it the backend would have encoded otherwise than the library; whether decoding gives the text."""
        if not self.cuts:
            return self._encode_whole(texts)
        if len(self.known) > KEPT or len(self.flat) > 64 * KEPT:
            self._forget()
        column = pa.array([None if t is None else self.before.normalize_str(t) for t in texts.to_pylist()], pa.string()) if self.before else texts
        spaced = pc.replace_substring(column.cast(pa.large_string()), MARK, " ")  # a marker of the text itself counts as a space
        if self.spec.strip_extra:
            spaced = pc.utf8_rtrim(spaced, " ")
        if self.spec.dummy_prefix:
            spaced = pc.if_else(pc.equal(spaced, ""), spaced, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), spaced, pa.scalar("", pa.large_string())))
        null = spaced.is_null().to_numpy(zero_copy_only=False)
        spaced = pc.fill_null(spaced, "")
        _, offsets, data = spaced.buffers()
        starts = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
        starts = starts - starts[0]
        space = raw == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(begins)
        of_text = np.diff(np.searchsorted(at, starts))  # cuts of each text
        cuts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = cuts.dictionary_encode()
        names = pc.replace_substring(coded.dictionary, " ", MARK).to_pylist()
        new = [c for c in names if c not in self.known]
        if new:
            self._learn(new)
        entry = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        own = entry[coded.indices.to_numpy()]
        n = self.size[own]
        ids = self.flat[ragged(self.first[own], n)]
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sums(n, of_text), out=ends[1:])
        if ends[-1] >= 1 << 31:
            raise ValueError("a batch of over 2**31 ids")
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
        differ = sums(self.differ[own].astype(np.int64), of_text)
        restored = sums((~self.lossless[own]).astype(np.int64), of_text) == 0
        same = pc.fill_null(pc.equal(pc.utf8_slice_codeunits(spaced, 1) if self.spec.dummy_prefix else spaced, texts.cast(pa.large_string())), False).to_numpy(zero_copy_only=False)
        restored &= same
        # cuts that do not give themselves back: the text as a whole decides
        for i in np.flatnonzero(~restored & ~null):
            restored[i] = self.decode([lists[i].as_py()])[0] == texts[i].as_py()
        return lists, differ, restored

    def _encode_whole(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        some = [t for t in texts.to_pylist() if t]
        done = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        differ = np.zeros(len(some), np.int64)
        if self.library:
            theirs = self.library.encode(some, num_threads=THREADS)
            differ = np.array([a != b for a, b in zip(done, theirs)], np.int64)
            done = theirs
        done, differ = iter(done), iter(differ.tolist())
        ids = [None if t is None else next(done) if t else [] for t in texts.to_pylist()]
        n_differ = np.array([next(differ) if t else 0 for t in texts.to_pylist()], np.int64)
        same = np.array([a == b for a, b in zip(self.decode(ids), texts.to_pylist())], bool)
        return pa.array(ids, pa.list_(pa.int32())), n_differ, same

    def encode(self, texts: list[str | None]) -> tuple[list[list[int] | None], list[int]]:
        """Ids of each text, and how many cuts of it the backend would have encoded otherwise than the library."""
        ids, differ, _ = self.encode_column(pa.array(texts, pa.string()))
        return ids.to_pylist(), differ.tolist()

    def decode(self, rows: list[list[int] | None]) -> list[str | None]:
        out: list[str | None] = []
        hard: list[int] = []
        for i, ids in enumerate(rows):
            try:
                text = None if ids is None else "".join(map(self.plain.__getitem__, ids))
                out.append(text[1:] if text and self.spec.dummy_prefix and text[0] == " " else text)
            except TypeError:  # unknown pieces and bytes of several to a character
                out.append(None)
                hard.append(i)
        for i, text in zip(hard, self.tokenizer.decode_batch([[x for x in rows[i] if x not in self.control] for i in hard], skip_special_tokens=False)):
            out[i] = text
        # where extra white space is removed, a decoded text starts with none
        return [t.lstrip(" ") if t else t for t in out] if self.spec.strip_extra else out


@lru_cache(2)
def backend(path: str, verify: bool = True) -> Backend:
    with open(path, "rb") as f:
        return Backend(f.read(), verify)


def encode(docs: DataFrame, model: str = MODEL, verify: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_differ, restored) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = backend(model, verify)
        for batch in batches:
            texts = batch.column(1)
            for i, j in steps(pc.utf8_length(texts).to_pylist(), BATCH_CHARS):
                own = texts[i:j]
                lists, differ, restored = b.encode_column(own)
                null = own.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists, pa.array(differ, pa.int32(), mask=null), pa.array(restored, mask=null)], ["doc_id", "ids", "n_differ", "restored"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_differ int, restored boolean")


def decode(rows: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = backend(model, False)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b.decode(batch.column(1).to_pylist()), pa.string())], ["doc_id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return only(rows, doc_id=id_col, ids=ids_col).mapInArrow(run, f"doc_id {kind}, text string")
