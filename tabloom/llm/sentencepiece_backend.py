"""SentencePiece models run by the tokenizers library: rebuilt from the protobuf, batched, checked for parity."""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import c, map_batches

# Where the public vocabulary files are; any SentencePiece model file will do.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
WORDS = re.compile(f"{MARKER}+[^{MARKER}]*")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the model format
UNIGRAM, BPE = 1, 2
# Encoded words kept by a worker before it starts afresh, and their characters; workers outlive their tasks.
MEMO_WORDS, MEMO_CHARS = 50_000, 1_000_000
RUN = 256  # new words encoded in a row


class PieceTokenizer:
    """A SentencePiece model on the tokenizers library.

    No piece of a usual model has the space marker behind another character, so words
    are independent: each distinct word is encoded once and remembered. A model with
    such a piece is encoded text by text. New words are encoded in one multithreaded
    batch and, with ``verify``, compared with the sentencepiece library at once (a run of
    words at a time), so parity is known for every text.
    """

    def __init__(self, model: bytes, verify: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.spec, self.pieces = proto.normalizer_spec, proto.pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.tokenizer = Tokenizer(_model(proto))
        self.tokenizer.decoder = _decoder(self.spec)
        self.normalizer = _normalizer(self.spec)
        known = {p.piece for p in self.pieces}
        usual = [p.piece for p in self.pieces if p.type in (NORMAL, USER_DEFINED)]
        self.by_word = (
            self.spec.escape_whitespaces and self.spec.add_dummy_prefix and MARKER in known
            and not any(re.search(f"[^{MARKER}]{MARKER}", p) for p in usual)
            and not any(p.type == USER_DEFINED for p in self.pieces))
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=model) if verify else None
        # what a piece stands for: bytes; a word's first marker becomes a space
        self.bytes_of = np.array([
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARKER, " ").encode()
            for p in self.pieces], object)
        self.starts = np.array([p.piece.startswith(MARKER) for p in self.pieces])
        self.simple = not (self.spec.precompiled_charsmap or self.spec.remove_extra_whitespaces)
        self.memo: dict[str, bytes] = {}
        self.memo_chars = 0
        self.odd: set[str] = set()  # words on which the libraries disagree

    def normalized(self, text: str) -> str:
        if self.by_word and self.simple:
            return MARKER + text.replace(" ", MARKER) if text else ""
        return self.normalizer.normalize_str(text) if text else ""

    def _learn(self, units: list[str], originals: list[str]) -> None:
        """Encode *units* in one multithreaded batch and compare with the sentencepiece library.

        Words with one marker are encoded many in a row: a piece that starts with the marker starts a word.
        """
        joined = [k for k, u in enumerate(units) if self.by_word and u[0] == MARKER and u[1:] and u[1] != MARKER]
        runs = [joined[k:k + RUN] for k in range(0, len(joined), RUN)]
        alone = set(joined)
        runs += [[k] for k in range(len(units)) if k not in alone]
        texts = ["".join([units[k] for k in run]) for run in runs]
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = found
        if self.reference is not None:
            known = [np.array(i, np.int32) for i in self.reference.encode(
                [" ".join([originals[k] for k in run]) for run in runs], num_threads=1)]
        for run, ids, theirs in zip(runs, found, known):
            if len(run) > 1:
                parts = np.split(ids, np.flatnonzero(self.starts[ids])[1:])
            else:
                parts = [ids]
            self.memo.update(zip([units[k] for k in run], [p.tobytes() for p in parts]))
            if units[run[0]] == MARKER and self.reference is not None:  # no text encodes to this alone
                theirs = np.array([self.reference.piece_to_id(MARKER)], np.int32)
            if not np.array_equal(ids, theirs):
                self.odd.update(
                    units[k] for k, p in zip(run, parts)
                    if len(run) == 1 or p.tolist() != self.reference.encode(originals[k]))

    def _words(self, text: str) -> list[str]:
        """Units that are encoded on their own: words with the markers before them."""
        if not text:
            return []
        if self.simple and "  " not in text and MARKER not in text and text[-1] != " " and text[0] != " ":
            return [MARKER + w for w in text.split(" ")]
        return WORDS.findall(self.normalized(text))

    def encode_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Token ids of each text, and whether the sentencepiece library gives the same ones."""
        memo = self.memo
        if len(memo) > MEMO_WORDS or self.memo_chars > MEMO_CHARS or not self.by_word:
            memo.clear()
            self.odd.clear()
            self.memo_chars = 0
        if self.by_word:
            split = [self._words(t) for t in texts]
            new = [w for w in set(chain.from_iterable(split)) if w not in memo]
            originals = [w[1:].replace(MARKER, " ") for w in new]  # the reference adds the first marker itself
        else:
            split = [[self.normalized(t)] for t in texts]
            new, originals = [ws[0] for ws in split], texts
        if new:
            self._learn(new, originals)
            self.memo_chars += sum(map(len, new))
        ids = [np.frombuffer(b"".join([memo[w] for w in ws]), np.int32) for ws in split]
        return ids, [not self.odd or self.odd.isdisjoint(ws) for ws in split]

    def decode_batch(self, ids: list) -> list[str]:
        """The texts of token ids; what is not valid UTF-8 goes through the library's own decoder."""
        out = []
        for one in ids:
            raw = b"".join(self.bytes_of[np.asarray(one, np.int64)].tolist())
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self.tokenizer.decode(list(map(int, one)), skip_special_tokens=False)
                out.append(text)
                continue
            out.append(text[1:] if self.spec.add_dummy_prefix and text.startswith(" ") else text)
        return out

    def plain(self, text: str) -> str:
        """What decoding the ids of *text* must give: the normalised text without markers."""
        if self.by_word and self.simple:
            return text.replace(MARKER, " ")
        shown = self.normalized(text).replace(MARKER, " ")
        return shown[1:] if self.spec.add_dummy_prefix and shown.startswith(" ") else shown


def _model(proto):
    from tokenizers import models

    bytes_too = proto.trainer_spec.byte_fallback
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    if proto.trainer_spec.model_type == UNIGRAM:
        return models.Unigram([(p.piece, p.score) for p in proto.pieces], unknown, bytes_too)
    if proto.trainer_spec.model_type != BPE:
        raise ValueError("only unigram and BPE models can be rebuilt")
    usable = {p.piece: (p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
    # two pieces merge if their union is a piece; the better score of the union goes first
    pairs = [
        (-score, number, piece[:k], piece[k:])
        for piece, (score, number) in usable.items() for k in range(1, len(piece))
        if piece[:k] in usable and piece[k:] in usable]
    pairs.sort(key=lambda m: (m[0], m[1], usable[m[2]][1], usable[m[3]][1]))
    return models.BPE(
        vocab={p.piece: i for i, p in enumerate(proto.pieces)}, merges=[m[2:] for m in pairs],
        unk_token=proto.pieces[unknown].piece, fuse_unk=True, byte_fallback=bytes_too)


def _normalizer(spec):
    from tokenizers import Regex, normalizers

    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if spec.escape_whitespaces else " "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    return normalizers.Sequence(steps)


def _decoder(spec):
    from tokenizers import decoders

    steps = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    return decoders.Sequence(steps)


@lru_cache(maxsize=2)
def _loaded(model: bytes, verify: bool) -> PieceTokenizer:
    return PieceTokenizer(model, verify)


def encode_decode(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE, verify: bool = True,
) -> DataFrame:
    """doc_id, n_tokens, token_ids, parity, round_trip and decoded_sha256 of every row.

    ``parity``: the sentencepiece library gives the same ids. ``round_trip``: decoding
    gives the normalised text again; ``decoded_sha256`` is the digest of what it gives.
    NULL and empty texts have no tokens. The model file is read once on the driver and
    travels with the task (a vocabulary, not data).
    """
    with open(model_file, "rb") as f:
        model = f.read()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        tokenizer = _loaded(model, verify)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        ids, same = tokenizer.encode_batch(texts)
        decoded = tokenizer.decode_batch(ids)
        sizes = np.array([len(i) for i in ids], np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
        return {
            "doc_id": batch.column(0), "n_tokens": pa.array(sizes), "token_ids": lists, "parity": same,
            "round_trip": [d == tokenizer.plain(t) for d, t in zip(decoded, texts)],
            "decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]}

    schema = (
        f"doc_id {kind}, n_tokens bigint, token_ids array<int>, parity boolean, round_trip boolean, "
        "decoded_sha256 string")
    return map_batches(docs.select(c(doc_id), c(text)), run, schema, rows=64)
