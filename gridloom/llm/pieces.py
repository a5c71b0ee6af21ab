"""Offset-preserving SentencePiece encoding and decoding (byte-pair models).

Normalisation replaces the longest prefix that the model's compiled character map knows, and keeps for each
normalised character the bytes of the source that it came from; every piece is projected through this alignment to a
span of the original text. Where no known prefix can begin, text is copied in one stretch, with its offsets counted.
A text is cut into chunks at places that no vocabulary piece spans, so a chunk's pieces don't depend on its neighbours
and are cached; the merges are the model's own (best score first, leftmost on ties). All texts take this one path; the
library encodes nothing here.

A null text counts as empty: no ids, decoded to the empty text. Any length of text works; a chunk too long for the
cache is merged with a heap. Repeated rows repeat; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from hashlib import sha256
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Chunks that a worker remembers, and the longest of them in characters.
CACHED, CACHED_LENGTH = 300_000, 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _lead_class(byte: int) -> str:
    """The characters whose UTF-8 begins with a byte, as a range for a pattern; none for a byte that only continues."""
    if byte < 0x80:
        return re.escape(chr(byte))
    if not 0xC2 <= byte < 0xF5:
        return ""
    first, last = (byte & 31) << 6, ((byte & 31) << 6) + 63
    if byte >= 0xF0:
        first, last = max(0x10000, (byte & 7) << 18), min(0x10FFFF, ((byte & 7) << 18) + (1 << 18) - 1)
    elif byte >= 0xE0:
        first, last = max(0x800, (byte & 15) << 12), ((byte & 15) << 12) + 4095
    return f"\\U{first:08x}-\\U{last:08x}"


class CharMap:
    """The compiled character map: a double-array trie of UTF-8 prefixes, and the texts that replace them."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]
        #: finds a character of whose first byte the map knows a prefix; None without a map
        self.starts = re.compile("[" + "".join(map(_lead_class, self._leads())) + "]").search if self.units else None

    def _leads(self) -> list[int]:
        root = self._jump(self.units[0])
        return [b for b in range(1, 256) if (at := root ^ b) < len(self.units) and self.units[at] & 0x800000FF == b]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest known prefix of data[at:]."""
        if not self.units:
            return None
        jump = self._jump
        node, best = jump(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= jump(unit)
            if unit >> 8 & 1:
                best = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if not best:
            return None
        return self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1]


class PieceModel:
    """A byte-pair SentencePiece model read from its file."""

    def __init__(self, path: str):
        self.path = path
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or any(p.type == 4 for p in model.pieces):
            raise ValueError("only byte-pair models without user-defined symbols are supported")
        norm = model.normalizer_spec
        self.charmap = CharMap(norm.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.pieces = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 5)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 5)}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unk, self.unk_text = model.trainer_spec.unk_id, model.trainer_spec.unk_surface
        inner = "".join(p for p in self.id if len(p) > 1)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece has a space inside: its chunks aren't independent")
        # a character of no longer piece is a chunk of its own
        self.alone = "\n" if "\n" not in inner else ""
        stop = re.escape(self.alone)
        self.chunks = re.compile((f"{stop}|" if stop else "") + f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+").findall

    # normalisation

    def _stretches(self, text: str):
        """(new text, length in characters of the source or 0 for the same) of stretches that cover a text."""
        if self.charmap.starts is None:
            yield text, 0
            return
        data = text.encode()
        at = byte = 0  # in characters, in bytes
        while at < len(text):
            hit = self.charmap.starts(text, at)
            to = hit.start() if hit else len(text)
            if to > at:
                byte += len(text[at:to].encode())
                yield text[at:to], 0
                at = to
                continue
            found = self.charmap.longest(data, byte)
            if found:
                n = len(data[byte : byte + found[1]].decode())
                yield found[0].decode(), n
                byte += found[1]
            else:
                n = 1
                yield text[at], 0
                byte += len(text[at].encode())
            at += n

    def normalise(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text; for each of its characters where in the source's bytes it begins and where it ends.

        Characters of one replacement share its span.
        """
        new, begin, end = self.aligned(text)
        return new, begin.tolist(), end.tolist()

    def aligned(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """What normalise() gives, as arrays."""
        lead = np.frombuffer(text.encode(), np.uint8)
        places = np.append(np.flatnonzero((lead & 0xC0) != 0x80), len(lead))  # of the source's characters
        if self.charmap.starts is None:
            new, begin, end = text, places[:-1], places[1:]
        else:
            out, first, last, at = [], [], [], 0
            for piece, n in self._stretches(text):
                out.append(piece)
                if n:
                    first.append(np.full(len(piece), places[at]))
                    last.append(np.full(len(piece), places[at + n]))
                    at += n
                else:
                    first.append(places[at : at + len(piece)])
                    last.append(places[at + 1 : at + len(piece) + 1])
                    at += len(piece)
            none = np.zeros(0, np.int64)
            new, begin, end = "".join(out), np.concatenate([none, *first]), np.concatenate([none, *last])
        if self.squeeze and new:
            chars = np.frombuffer(new.encode("utf-32-le"), np.uint32)
            keep = chars != 32
            keep[1:] |= keep[:-1]  # the first space of a run
            keep[0] = chars[0] != 32
            while len(keep) and chars[keep].size and chars[keep][-1] == 32:
                keep[np.flatnonzero(keep)[-1]] = False
            new, begin, end = chars[keep].tobytes().decode("utf-32-le"), begin[keep], end[keep]
        if not new:
            return "", begin[:0], end[:0]
        if self.dummy:
            new, begin, end = " " + new, np.append(begin[0], begin), np.append(begin[0], end)
        return new.replace(" ", SPACE) if self.escape else new, begin, end

    # merging

    def merge(self, chunk: str) -> list[str]:
        """The pieces of one chunk by the model's merges."""
        if len(chunk) == 1:
            return [chunk]
        parts, score = list(chunk), self.score
        if len(parts) <= CACHED_LENGTH:
            none = float("-inf")
            get = score.get
            pairs = [get(x, none) for x in map(add, parts, parts[1:])]
            while pairs:
                best = max(pairs)
                if best == none:
                    break
                i = pairs.index(best)
                parts[i] = both = parts[i] + parts[i + 1]
                del parts[i + 1], pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + both, none)
                if i < len(pairs):
                    pairs[i] = get(both + parts[i + 1], none)
            return parts
        size = len(parts)
        after, before = [*range(1, size), -1], [-1, *range(size - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def ids_of(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unk]

    def encode_offsets(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(id, piece, begin, end) of each token; begin and end are byte offsets in the source.

        Of the bytes that spell an unknown character all but the last are empty spans at its beginning.
        """
        norm, begin, end = self.normalise(text or "")
        out, at = [], 0
        for chunk in self.chunks(norm):
            for piece in self.merge(chunk):
                b = begin[at]
                at += len(piece)
                e = begin[at] if at < len(norm) else end[-1]
                ids = self.ids_of(piece)
                if ids == [self.unk] and out and out[-1][0] == self.unk:
                    out[-1] = (self.unk, out[-1][1] + piece, out[-1][2], e)
                elif len(ids) == 1:
                    out.append((ids[0], piece, b, e))
                else:
                    out += [(i, self.pieces[i], b, b) for i in ids[:-1]] + [(ids[-1], self.pieces[ids[-1]], b, e)]
        return out

    def encode(self, text: str | None) -> list[int]:
        return [t[0] for t in self.encode_offsets(text)]

    # decoding

    def surface(self, ids, first: bool = False) -> str:
        """The text of ids; first: they begin the text, so one leading space is the encoder's own."""
        out, held = [], bytearray()

        def spell() -> None:
            at = 0
            while at < len(held):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[at : at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                at += n
            held.clear()

        for i in ids:
            kind = self.kind[i]
            if kind == 6:
                held.append(int(self.pieces[i][3:5], 16))
                first = False
                continue
            if held:
                spell()
            if kind == 3:
                continue
            piece = self.unk_text if kind == 2 else self.pieces[i]
            if first and self.dummy and piece.startswith(SPACE):
                piece = piece[1:]
            first = False
            out.append(piece.replace(SPACE, " "))
        spell()
        return "".join(out)

    def decode(self, ids) -> str:
        return self.surface(ids, first=True)


class ChunkCache:
    """What `form` makes of the pieces of a chunk; two generations of remembered chunks bound the memory."""

    def __init__(self, model: PieceModel, form):
        self.model, self.form = model, form
        self.young, self.old = {}, {}

    def values(self, chunks: list[str]) -> list:
        try:
            return [self.young[c] for c in chunks]
        except KeyError:
            return [self._value(c) for c in chunks]

    def _value(self, chunk: str):
        v = self.young.get(chunk)
        if v is None:
            v = self.old.get(chunk)
            if v is None:
                v = self.form(self.model.merge(chunk))
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            if len(chunk) <= CACHED_LENGTH:
                self.young[chunk] = v
        return v


def encoded(model: PieceModel):
    """A function of texts: of each (ids joined by commas, count, decoded text, ends of the spans as int64 bytes)."""
    one = spelt(model)

    def run(texts):
        for a, n, back, _, end in map(one, texts):
            yield a, n, back, end.astype("<i8").tobytes()

    return run


def spelt(model: PieceModel):
    """A function of a text: (ids joined by commas, count, decoded text, begins and ends of the spans)."""

    def form(pieces: list[str]):
        """Ids joined by commas, their number, their text, and the characters that each covers as int32 bytes."""
        try:
            return ",".join([named[p] for p in pieces]), len(pieces), "".join(pieces).replace(SPACE, " "), array("i", map(len, pieces)).tobytes()
        except KeyError:  # a character that is spelt by its bytes
            pass
        ids, sizes = [], []
        for piece in pieces:
            own = model.ids_of(piece)
            ids += own
            sizes += [0] * (len(own) - 1) + [len(piece)]
        return ",".join(map(str, ids)), len(ids), model.surface(ids), np.array(sizes, np.int32).tobytes()

    named = {p: str(i) for p, i in model.id.items()}
    cache = ChunkCache(model, form)
    joined = bool(model.bytes) and model.dummy  # else unknown characters run together across chunks, or nothing precedes

    def run(text: str | None):
        if not joined:
            tokens = model.encode_offsets(text)
            ids = [t[0] for t in tokens]
            return ",".join(map(str, ids)), len(ids), model.decode(ids), np.array([t[2] for t in tokens], np.int64), np.array([t[3] for t in tokens], np.int64)
        norm, begin, end = model.aligned(text or "")
        if not norm:
            return "", 0, "", begin, end
        ids, n, back, sizes = zip(*cache.values(model.chunks(norm)), strict=True)
        upto = np.cumsum(np.frombuffer(b"".join(sizes), np.int32), dtype=np.int64)
        first = np.append(begin, end[-1])
        # the spans of bytes that spell a character are empty but for the last, as in encode_offsets()
        return ",".join(ids), sum(n), "".join(back)[1:], first[np.append(0, upto[:-1])], first[upto]

    return run


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """docs with ids array<int>, begins and ends array<long> (byte spans in the text) for each row's text."""
    path = model_path or default_model()

    def run(batches):
        model = PieceModel(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                tokens = model.encode_offsets(one.column("text")[0].as_py())
                cells = [pa.array([[t[k] for t in tokens]], pa.list_(kind)) for k, kind in ((0, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
                yield pa.RecordBatch.from_arrays([one.column("doc_id"), *cells], ["doc_id", "ids", "begins", "ends"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of each row's whole text; one narrow pass, no shuffle.

    spans_crc32 is that of all begins and then all ends of the pieces, as 64-bit numbers.
    """
    path = model_path or default_model()

    def run(batches):
        one = spelt(PieceModel(path))
        for batch in batches:
            n, ids, back, spans = [], [], [], []
            for text in batch.column("text"):
                a, b, c, begin, end = one(text.as_py())
                n.append(b)
                ids.append(sha256(a.encode()).hexdigest())
                back.append(sha256(c.encode()).hexdigest())
                spans.append(zlib.crc32(end.astype("<i8").tobytes(), zlib.crc32(begin.astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string()), pa.array(spans, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")
