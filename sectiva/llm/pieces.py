"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here and rebuilt as a tokenizers pipeline: normaliser, metaspace
marker, BPE merges by piece score or unigram scores, byte fallback, and the decoder.  Texts are
cut where no piece can span the cut, so each distinct segment of some batches is encoded once, many
of them in one text, and texts are reassembled from segment ids.  Parity with the reference
library of the model format is verified on a sample before a run, and on a row of every batch in it.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import small_batches

#: Where the model lies unless a caller names another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BLANKS = re.compile(" {2,}")
#: Fixed values of the model format: piece types, model types, field numbers with their defaults.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BYTE_NAME = re.compile("<0x[0-9A-F]{2}>")
#: Bytes of text after which no further batch is encoded together with those before.
TOGETHER = 1 << 22
#: Distinct segments that one call to the library encodes, and those of them in one text.
SLICE, JOINED = 32_768, 128
#: Threads of one worker's calls, unless RAYON_NUM_THREADS says otherwise.
THREADS = 2
#: Texts on which parity is verified before a run.
PARITY_ROWS = 200


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return x, i


def wire(b: bytes):
    """(field number, value) of a protobuf message: ints, floats' raw bytes or byte strings."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file states."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(blob: bytes) -> Model:
    m = Model()
    for number, value in wire(blob):
        if number == 1:
            own = dict(wire(value))
            m.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(wire(value))
            m.kind, m.unk, m.byte_fallback = own.get(3, UNIGRAM), own.get(40, 0), bool(own.get(35, 0))
        elif number == 3:
            own = dict(wire(value))
            m.charsmap, m.dummy_prefix, m.squeeze, m.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Pairs of pieces whose join is a piece, best-scored first."""
    rank = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER)}
    score = {p: s for p, s, _ in m.pieces}
    found = [(-score[p], rank[p], k, (p[:k], p[k:])) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [pair for *_, pair in sorted(found)]


def backend(m: Model):
    """A tokenizers pipeline without a normaliser, its decoder joining pieces without trimming."""
    from tokenizers import Tokenizer, decoders, models

    if m.kind == BPE:
        vocab = {p: i for i, (p, *_) in enumerate(m.pieces)}
        core = models.BPE(vocab=vocab, merges=merges(m), unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk, m.byte_fallback)
    t = Tokenizer(core)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, blob: bytes):
        from tokenizers import normalizers, pre_tokenizers

        self.model = m = parse(blob)
        self.tokenizer = backend(m)
        self.normalizer = normalizers.Precompiled(m.charsmap) if m.charsmap else None
        usual = [p for p, _, kind in m.pieces if kind in (NORMAL, USER)]
        self.cuts = m.escape and not any(MARK in p.lstrip(MARK) for p in usual) and not any(kind == USER for *_, kind in m.pieces)
        if self.cuts:
            self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Unigram models take the name of a byte piece in a text for that piece; cutting at characters that are in no longer piece keeps most names apart.
        joined = {c for p in usual if len(p) > 1 for c in p}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in joined and self.cuts and m.kind == UNIGRAM and m.byte_fallback))
        self.alone = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]") if alone else None
        self.odd = np.array([kind not in (NORMAL, USER) or p.startswith("<0x") for p, _, kind in m.pieces], bool)
        # Bytes that a piece stands for; the unknown one stands for any number.
        self.width = np.array([1 if BYTE_NAME.fullmatch(p) else len(p.encode()) for p, *_ in m.pieces], np.int64)
        self.width[m.unk] = 0
        #: Distinct segments of the last call.
        self.memo = pa.array([], pa.large_string())

    def plain(self, text: str) -> str:
        """A text after the model's character map; blanks at its ends and repeated ones go if the model says so, other white space stays."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if self.model.squeeze:
            text = text.strip(" ")
            if "  " in text:
                text = BLANKS.sub(" ", text)
        return text

    def marked(self, text: str) -> str:
        """A plain text with the marker for blanks and before it."""
        if not text:
            return ""
        text = (" " if self.model.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.model.escape else text

    def segments(self, plain: list[str]) -> pa.ListArray:
        """Marked texts, each cut before every run of markers: no piece spans that; whole if the model has a piece that might."""
        texts = map(self.marked, plain)
        if self.alone:
            texts = (" ".join(self.alone.findall(t)) for t in texts)
        elif self.cuts:  # marked texts have no blanks of their own, so blanks can stand for cuts
            texts = (t.replace(MARK, f" {MARK}").replace(f"{MARK} ", MARK) for t in texts)
        texts = pa.array(texts, pa.large_string(), size=len(plain))
        return pc.split_pattern(texts, " ") if self.cuts else pa.ListArray.from_arrays(np.arange(len(plain) + 1, dtype=np.int32), texts)

    def ids_of(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, number of each), many segments in one text where the bytes of their pieces tell them apart."""
        texts = new.to_pylist()
        if self.cuts:
            joined = [" ".join(texts[k : k + JOINED]) for k in range(0, len(texts), JOINED)]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), np.int32, sum(map(len, got)))
            ends = np.concatenate(([0], np.cumsum(self.width[ids])))
            want = np.cumsum(pc.binary_length(new).to_numpy())
            upto = np.searchsorted(ends, want, "right") - 1
            if self.width[ids].all() and upto[-1] == len(ids) and (ends[upto] == want).all():
                return ids, np.diff(upto, prepend=0)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(n.sum())), n

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments, number of each, whether decoding gives each back)."""
        ids, n = self.ids_of(new)
        ends = np.cumsum(n)
        # Pieces that stand for themselves join to their segment; only the others are decoded.
        odd = np.flatnonzero((np.bincount(np.repeat(np.arange(len(new)), n), self.odd[ids], len(new)) > 0) | (n == 0))
        sound = np.ones(len(new), bool)
        back = self.tokenizer.decode_batch([ids[ends[i] - n[i] : ends[i]].tolist() for i in odd], skip_special_tokens=False)
        sound[odd] = [b == new[i].as_py().replace(MARK, " ") for b, i in zip(back, odd.tolist(), strict=True)]
        return ids, n, sound

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text, whether decoding gives each text back)."""
        clean = [self.plain(t or "") for t in texts]
        same = np.array([MARK not in p and p == (t or "") for p, t in zip(clean, texts, strict=True)], bool)
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64), same
        cut = self.segments(clean)
        coded = cut.values.dictionary_encode()
        self.memo = new = coded.dictionary
        at, text_of = coded.indices.to_numpy(), cut.offsets.to_numpy()
        flat, lengths, good = map(np.concatenate, zip(*(self.learn(new.slice(k, SLICE)) for k in range(0, len(new), SLICE)), strict=True))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        ids = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(flat)).take(coded.indices).flatten().to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths[at])))
        unsound = np.concatenate(([0], np.cumsum(~good[at])))
        return ids, ends[text_of], (unsound[text_of[1:]] == unsound[text_of[:-1]]) & same

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of whole sequences; the marker put before a text is taken off."""
        out = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [x[1:] if self.model.dummy_prefix and x[:1] == " " else x for x in out]


def together(batches):
    """Lists of batches whose texts have ``TOGETHER`` bytes, or one batch more: equal segments of a list are encoded once."""
    group, held = [], 0
    for batch in batches:
        group.append(batch)
        held += batch.column(1).nbytes
        if held >= TOGETHER:
            yield group
            group, held = [], 0
    if group:
        yield group


def _encode(batches, blob, pieces, rebuilt=True):
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    theirs, k = None, 0
    for group in together(batches):
        texts = [t for batch in group for t in batch.column(1).to_pylist()]
        theirs = theirs or reference(blob) if texts else theirs
        all_ids, all_ends, all_sound = pieces.encode(texts) if rebuilt else by_reference(theirs, texts)
        first = 0
        for batch in group:
            last = first + len(batch)
            offsets, sound = all_ends[first : last + 1], all_sound[first:last]
            ids, offsets = all_ids[offsets[0] : offsets[-1]], offsets - offsets[0]
            at = k % max(len(batch), 1)
            if rebuilt and len(batch) and differs(pieces, theirs, texts[first + at] or "", ids[offsets[at] : offsets[at + 1]].tolist(), bool(sound[at])):
                ids, offsets, sound = by_reference(theirs, texts[first:last])
            values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), values, pa.array(sound)], names=["doc_id", "n_tokens", "ids", "restored"])
            first, k = last, k + 1


def reference(blob: bytes):
    """The model format's own library."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=blob)


def by_reference(theirs, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Pieces.encode`` gives, by the model's own library."""
    got = [theirs.encode(t or "") for t in texts]
    ids = np.array([i for x in got for i in x], np.int32)
    sound = np.array([theirs.decode(x) == (t or "") for x, t in zip(got, texts, strict=True)], bool)
    return ids, np.concatenate(([0], np.cumsum([len(x) for x in got], dtype=np.int64))), sound


def differs(pieces: Pieces, theirs, text: str, ids: list[int], restored: bool) -> str:
    """How ids, decoded text or the ``restored`` flag of a text differ from the model's own library; empty if they don't."""
    if ids != theirs.encode(text):
        return "the rebuilt tokenizer's ids differ from those of the model's own library"
    back = pieces.decode([ids])[0]
    if back != theirs.decode(ids) or restored and back != text:
        return "a decoded text differs from that of the model's own library, or from the text"
    return ""


def check_parity(pieces: Pieces, theirs, text: str, ids: list[int], restored: bool) -> None:
    """Raise unless ids, decoded text and the ``restored`` flag of a text agree with the model's own library."""
    if found := differs(pieces, theirs, text, ids, restored):
        raise ValueError(found)


def _decode(batches, pieces):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces.decode([x or [] for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])


def verify_parity(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH, rows: int = PARITY_ROWS) -> tuple[int, int]:
    """(rows compared, rows that differ): ids and decoded texts against the model's own library on ``rows`` rows."""
    with open(model_path, "rb") as f:
        blob = f.read()
    theirs, ours = reference(blob), Pieces(blob)
    texts = [r[0] or "" for r in docs.select(F.col(text).cast("string")).limit(rows).collect()]
    ids, ends, sound = ours.encode(texts)
    return len(texts), sum(bool(differs(ours, theirs, t, ids[ends[k] : ends[k + 1]].tolist(), bool(sound[k]))) for k, t in enumerate(texts))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, ids, restored) for every row: ids of the whole text, and whether they decode to it.

    Null and empty texts have no ids; ``restored`` is false where the text holds the marker
    character itself or the model's normaliser changes it.  Repeated rows and null ids are kept;
    other columns are ignored; an empty table gives no rows.  The model is read on the driver
    and sent along, so executors need no file.  Where the model's own library segments a text differently (segmentations of
    equal score), its ids count: if a row of the sample differs, that library encodes everything, and if the row looked at
    in a batch differs, it encodes that batch; no difference ends a run.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        blob = f.read()
    rebuilt = not verify_parity(docs, text, model_path)[1]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _encode(it, blob, Pieces(blob), rebuilt), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids array<int>, restored boolean")


def decode_documents(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of arrays of ids; null or empty arrays give an empty text."""
    with open(model_path, "rb") as f:
        blob = f.read()
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(lambda it: _decode(it, Pieces(blob)), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
