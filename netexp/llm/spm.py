"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds every piece that may match text. One pass over a segment
visits each position once; the outputs found there (the longest piece, then
along the output links every piece that is a suffix of it) relax the best score
of that position as they come. A character that is no piece costs the lowest score less 10
and is written as its UTF-8 bytes where the model has byte pieces. Equal scores
keep the longest last piece. The scores are those of the model file, taken as
log weights whatever the model's own training was (for a file of merges the
result is the best-scoring segmentation, not the merge order).

No piece of the usual models holds a space mark after another character, so the
best segmentation of a text is that of its segments (space marks, then other
characters), and equal segments are looked up; models with such pieces are run
over whole texts.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.llm.cluster import small_batches

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 200_000
#: Fixed values of the model format: kinds of piece.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE_PIECE = 1, 2, 3, 4, 5, 6


class SentencePieceCodec:
    """Built from the bytes of a .model file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models whose normaliser is the identity are supported")
        self.unknown, self.byte_ids, self.bytes_of = 0, {}, []
        normal = [p.score for p in proto.pieces if p.type == NORMAL]
        lowest, highest = min(normal, default=0.0), max(normal, default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.automaton, split = ahocorasick.Automaton(), True
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE_PIECE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type in (NORMAL, USER_DEFINED):
                score = p.score if p.type == NORMAL else len(p.piece) * highest - 0.1
                self.automaton.add_word(p.piece, (i, len(p.piece), score))
                split &= SPACE not in p.piece.lstrip(SPACE)
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.bytes_of.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
                if p.type == UNKNOWN:
                    self.unknown = i
        if len(self.byte_ids) < 256:
            self.byte_ids = {}
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()
        self.segment = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if split else "(?s:.+)", re.S).findall
        self.cache: dict[str, bytes] = {}

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text with space marks."""
        n, unknown = len(text), self.unknown_score
        score, back = [0.0] * (n + 1), [(-1, 1)] * (n + 1)
        done, best, by, single = 0, None, (-1, 1), False  # position done + 1 as far as it has been relaxed
        for last, (i, length, own) in self.automaton.iter(text) if self.any else ():  # longest first, along the output links
            while done < last:  # no more pieces end at done + 1; a character that is no piece may
                new = score[done] + unknown
                if not single and (best is None or new > best):
                    best, by = new, (-1, 1)
                done += 1
                score[done], back[done], best, single = best, by, None, False
            new = score[last + 1 - length] + own
            if best is None or new > best:
                best, by = new, (i, length)
            single = length == 1
        while done < n:
            new = score[done] + unknown
            if not single and (best is None or new > best):
                best, by = new, (-1, 1)
            done += 1
            score[done], back[done], best, single = best, by, None, False
        out: list[int] = []
        while n:
            i, length = back[n]
            n -= length
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(text[n].encode())]
            else:
                out.append(self.unknown)
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        marked = text.replace(" ", SPACE)
        cache, out = self.cache, []
        for segment in self.segment(SPACE + marked if self.dummy_prefix else marked):
            ids = cache.get(segment)
            if ids is None:
                ids = np.array(self.best(segment), dtype=np.int32).tobytes()
                if len(segment) <= 48:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[segment] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; a space mark is a space, bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _encode(model):
    def encode(batches):
        codec = SentencePieceCodec(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                ids = [codec.encode(t or "") for t in texts]
                same = [codec.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts, strict=True)]
                bounds = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.record_batch([part.column(0), pa.array(np.diff(bounds).astype(np.int64)), tokens, pa.array(same)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    return encode


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, token_ids, round_trip (decoding gives the text back).

    A null or empty text has no tokens (round_trip true). A text that itself
    holds U+2581 decodes with spaces in its place, so round_trip is false there.
    Texts are encoded whole. Other columns are ignored; empty tables and
    repeated rows need no care.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_encode(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, token_ids array<int>, round_trip boolean")


def sentencepiece_decode(spark: SparkSession, tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, token_ids array<int>) to (doc_id, text); null ids give the empty text."""
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def decode(batches):
        codec = SentencePieceCodec(model.value)
        for batch in batches:
            texts = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "token_ids").mapInArrow(decode, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
