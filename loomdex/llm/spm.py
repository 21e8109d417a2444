"""SentencePiece encoding and decoding that keeps every piece's byte span in the original text.

Normalisation walks the text with the model's compiled character map (a double-array trie over UTF-8 prefixes, longest
match first) and records for each normalised byte where in the source it came from. The merges run on chunks between
which no piece of the vocabulary can reach; each distinct chunk is segmented once per worker. Pieces are then projected
through the alignment to byte spans of the source.

Null text counts as the empty text: no pieces, decoded "". Repeated rows give equal results; columns of the input other
than the id and text columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from loomdex.llm.shared import bounded, tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes that each of the two generations of chunks that a worker remembers takes, and the longest chunk remembered.
CACHE_BYTES = 16 << 20
LONGEST_CHUNK = 256
#: What a remembered chunk takes besides its text and ids.
ENTRY = 200


class CharsMap:
    """The compiled map: 4 bytes of trie size, a double array of 32-bit units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the map, and its replacement."""
        units, best = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = i - at + 1, self.texts[value : self.texts.index(b"\0", value)]
        return best


class Piecer:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        if proto is None:
            with open(path or public_tokenizers.path(MODEL), "rb") as f:
                proto = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that attach white space to the end of words are not supported")
        self.pieces = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        self.lengths = np.array([1 if k == 6 else len(p.encode()) for p, k in zip(self.pieces, kinds, strict=True)], np.int64)
        self.byte = np.array([k == 6 for k in kinds])
        self.opens = np.array([p.startswith(SPACE) for p in self.pieces])
        self.unknown = self.sp.unk_id()
        across = any(re.search(f"[^{SPACE}]{SPACE}", p) for p, k in zip(self.pieces, kinds, strict=True) if k in (1, 4))
        #: Chunks: blanks and what follows up to the next blank; the library can take them one by one.
        self.plain = not (self.map.units or self.squeeze or across or not self.dummy or not self.escape or 4 in kinds)
        self.chunk = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte where its origin begins."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            if not data:
                return b"", np.zeros(1, np.int64)
            raw = np.frombuffer(data, np.uint8)
            width = np.where(raw == 0x20, 3 if self.escape else 1, 1)
            align = np.append(np.repeat(np.arange(len(raw)), width), len(raw))
            out = data.replace(b" ", SPACE.encode()) if self.escape else data
            if self.dummy:
                lead = SPACE.encode() if self.escape else b" "
                out, align = lead + out, np.concatenate([np.zeros(len(lead), np.int64), align])
            return out, align
        blank, parts, align, at, gap = SPACE.encode() if self.escape else b" ", [], [], 0, self.squeeze
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = n, data[at : at + n]
            n, piece = found
            for k, char in enumerate(piece.decode()):
                if char == " ":
                    if gap and self.squeeze:
                        continue
                    got = blank
                else:
                    got = char.encode()
                if not parts and self.dummy:
                    parts.append(blank)
                    align += [at] * len(blank)
                gap = char == " "
                parts.append(got)
                align += [at] * len(got)
            at += n
        end = len(data)
        if self.squeeze:
            while len(parts) > 1 and parts[-1] == blank:
                end = align[-1]
                parts.pop()
                del align[len(align) - len(blank) :]
        return b"".join(parts), np.array([*align, end], np.int64)

    def _learn(self, chunks: list[list[str]]) -> dict[str, str]:
        """Ids, as text, of all these chunks. Short ones are remembered, as far as CACHE_BYTES go; text without blanks is one
        long chunk, which is not worth keeping."""
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        new, other, out = [], [], {}
        for c in set().union(*chunks) if chunks else ():
            said = young.get(c)
            if said is not None:
                out[c] = said
            elif (said := old.get(c)) is not None:
                out[c] = said
                self._keep(c, said)
            elif c and c[0] != " ":
                new.append(c)
            else:
                other.append(c)
        if new:
            ids = np.array(self.sp.encode(" ".join(new)), np.int64)
            said, cuts = list(map(str, ids.tolist())), [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            for c, a, b in zip(new, cuts[:-1], cuts[1:], strict=True):
                out[c] = ",".join(said[a:b])
                self._keep(c, out[c])
        for c in other:
            out[c] = ",".join(map(str, self.sp.encode(c))) if c else str(self.sp.piece_to_id(SPACE))
            self._keep(c, out[c])
        return out

    def _keep(self, chunk: str, said: str) -> None:
        if len(chunk) <= LONGEST_CHUNK:
            self.young[chunk] = said
            self.held += len(chunk) + len(said) + ENTRY

    def _chunks(self, text: str) -> list[str]:
        """Each without its first blank, which the library puts before whatever it is given."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in self.chunk.findall(" " + text.replace(SPACE, " "))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text, in decimal, joined by commas."""
        if not self.plain:
            return [",".join(map(str, ids)) for ids in self.sp.encode(texts, num_threads=1)]
        out = []
        for at in range(0, len(texts), 64):
            chunks = [self._chunks(t) for t in texts[at : at + 64]]
            known = self._learn(chunks)
            out += [",".join([known[c] for c in x]) for x in chunks]
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte span of every piece in the original text. Pieces of one source character share its bytes."""
        data, align = self.normalise(text)
        if not self.plain and (ids == self.unknown).any():
            pieces = self.sp.encode(text, return_type="proto").pieces
            lengths = np.array([len(p.piece.encode()) for p in pieces], np.int64)
        else:
            lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if len(ids) and ends[-1] != len(data):
            raise ValueError("the pieces do not tile the normalised text")
        begins = ends - lengths
        end = align[ends] if len(ids) else ends
        if len(ids):
            same = (end == align[begins]) & self.byte[ids]  # a byte inside one source character: up to its end
            following = np.searchsorted(align, align[begins], side="right")
            end = np.where(same, align[np.minimum(following, len(align) - 1)], end)
        return align[begins] if len(ids) else begins, end

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def parsed(said: str) -> np.ndarray:
    return np.fromstring(said, np.int64, sep=",") if said else np.zeros(0, np.int64)


@lru_cache(2)
def piecer(path: str | None = None) -> Piecer:
    return Piecer(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, starts array<long>, ends array<long>): pieces and their byte spans, per row of docs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = piecer(path)
        for pdf in frames:
            ids, starts, ends = [], [], []
            texts = [t or "" for t in pdf["text"]]
            for text, said in zip(texts, p.encode(texts), strict=True):
                row = parsed(said)
                a, b = p.spans(text, row)
                ids.append(row)
                starts.append(a)
                ends.append(b)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids, "starts": starts, "ends": ends})

    bounded(docs.sparkSession)
    spark_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spark_docs.mapInPandas(tidy(run), "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null or empty ids give ""."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = piecer(path)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [p.decode([] if x is None else np.asarray(x).tolist()) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and spans_tile: the spans cover every source byte
    in order without a gap. Encodes, projects and decodes each whole text as encode() and decode() do, and keeps digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = piecer(path)
        for pdf in frames:
            rows = []
            texts = [t or "" for t in pdf["text"]]
            for text, said in zip(texts, p.encode(texts), strict=True):
                ids = parsed(said)
                a, b = p.spans(text, ids)
                tile = bool(len(a) == 0 or (a[0] == 0 and b[-1] == len(text.encode()) and (a[1:] <= b[:-1]).all()))
                back = p.decode(ids.tolist())
                rows.append((len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), tile))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_tile"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    bounded(docs.sparkSession)
    part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return part.mapInPandas(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_tile boolean")
