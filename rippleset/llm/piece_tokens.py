"""SentencePiece encoding and decoding (merge type) by backtracking.

The encoder walks a text left to right. At each place an Aho-Corasick pass has named the longest piece; a piece is kept when
it is compatible with the one before, that is, when merging the two pieces' characters afresh gives exactly these two pieces.
If not, the next shorter piece at that place is tried, then the piece before is taken back. A bitfield remembers the places
from which no valid encoding goes on, so no place fails twice. The result is the one that merging by score gives.

Cases: a null or empty text has no ids and decodes to the empty text. Characters without a piece become byte pieces. The mark
U+2581 in a text reads as a space, as in the library. Text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleset.llm.common import slices, table

SPACE = "▁"
#: Distinct chunks whose ids a worker remembers; when full it starts anew.
CACHE = 300_000

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_MODELS: dict[str, PieceModel] = {}


class PieceModel:
    """Vocabulary of one model file, with the encoder's tables."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge-type models without text normalisation are handled")
        if any(p.type == _USER for p in proto.pieces) or not proto.trainer_spec.byte_fallback:
            raise ValueError("models with user-defined pieces or without byte fallback are not handled")
        self.dummy_prefix = spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _UNUSED)}
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = [0] * 256
        #: UTF-8 bytes that an id stands for.
        self.surface = []
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == _CONTROL:
                self.surface.append(b"")
            elif p.type == _UNKNOWN:
                self.surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.surface.append(p.piece.replace(SPACE, " ").encode())
        self.alphabet = {c for piece in self.ids for c in piece}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        #: The longest piece that is a proper prefix of a piece, if there is one.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.compatible: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        # No piece goes on after a non-space with a space, so a text falls into independent chunks at each word's start.
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            self.chunks = re.compile(r"(?s).+")
        elif "\n" in self.alphabet:
            self.chunks = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.chunks = re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the adjacent pair of the best score, leftmost first, until none is left."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(text) and (both := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.scores[both], i, parts[i] + parts[j]))

        for i in range(len(text) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or (j := after[i]) >= len(text) or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < len(text):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging both pieces' characters afresh gives these two pieces again."""
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > CACHE:
                self.compatible.clear()
            found = self.compatible[key] = self.merge(left + right) == [left, right]
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text over the alphabet."""
        if text in self.ids and self.merge(text) == [text]:
            return [text]
        size, ids, pairs, shorter = len(text), self.ids, self.compatible, self.shorter
        longest: list[str | None] = [None] * size
        for end, (before, piece) in self.automaton.iter(text):
            longest[end - before] = piece  # ends ascend, so the longest of a place comes last
        if None in longest:
            return self.merge(text)  # a character of the alphabet that is no piece by itself
        open_at = bytearray(b"\1") * (size + 1)
        pieces: list[str] = []
        at, piece, last = 0, longest[0], None
        while at < size:
            while piece is not None:
                if open_at[at + len(piece)]:
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if fits or fits is None and self.fits(last, piece):
                        break
                piece = shorter[piece]
            if piece is not None:
                pieces.append(piece)
                at += len(piece)
                last, piece = piece, longest[at] if at < size else None
            elif last is None:
                return self.merge(text)
            else:
                open_at[at] = 0
                piece = pieces.pop()
                at -= len(piece)
                last = pieces[-1] if pieces else None
        return pieces

    def chunk(self, text: str) -> bytes:
        """Ids of one chunk as int32 bytes."""
        if self.alphabet.issuperset(text):
            return self.known(text)
        return b"".join([self.known(part) if known else np.asarray([self.byte_ids[b] for b in part.encode()], np.int32).tobytes() for known, part in self.parts(text)])

    def known(self, text: str) -> bytes:
        """Ids of a text over the alphabet."""
        ids = self.ids
        pieces = self.backtrack(text)
        try:
            return array("i", [ids[p] for p in pieces]).tobytes()
        except KeyError:  # a character of the alphabet that is no piece by itself
            return array("i", [i for p in pieces for i in ([ids[p]] if p in ids else [self.byte_ids[b] for b in p.encode()])]).tobytes()

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """Runs of characters that are, or are not, of the alphabet."""
        return [(known, "".join(run)) for known, run in groupby(text, self.alphabet.__contains__)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as int32 bytes."""
        if not text:
            return b""
        cache, out = self.cache, []
        text = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        for chunk in self.chunks.findall(text):
            ids = cache.get(chunk)
            if ids is None:
                ids = self.chunk(chunk)
                if len(cache) >= CACHE:
                    cache.clear()
                if len(chunk) <= 64:
                    cache[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces joined, marks read as spaces, the first of them (the encoder's own) taken off."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", errors="replace")
        first = next((i for i in ids if surface[i]), None)
        if self.dummy_prefix and first is not None and surface[first][:1] == b" " and first not in self.byte_ids:
            return text[1:]
        return text


def model(path: str) -> PieceModel:
    """The model of a file, once per worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id_col``, ``ids array<int>`` and, if asked for, ``decoded string`` of every row; other columns are left out.

    One pass over the rows without a shuffle; a worker holds the vocabulary, a bounded cache of chunks and a few hundred texts.
    """
    fields = [T.StructField("_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] * decode

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(model_path)
        for batch in slices(batches):
            encoded = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in encoded)], dtype=np.int32)
            values = np.frombuffer(b"".join(encoded), np.int32)
            out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]
            if decode:
                out.append(pa.array([pieces.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["_id", "ids", "decoded"][: len(out)])

    got = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return got.mapInArrow(run, T.StructType(fields)).withColumnRenamed("_id", id_col)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids and their decoded text of every document, as counts and digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
