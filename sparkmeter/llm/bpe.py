"""Byte-level BPE encoding and decoding by a dynamic programme over prefixes.

For every byte prefix of a piece there is exactly one token that can end its encoding. ``PrefixCodec``
stores that token for each prefix: the last token of a prefix is the longest vocabulary entry that ends
there and that may stand after the stored last token of the prefix before it. Two tokens may stand
together if the merges of their joined bytes give the two tokens back. The table makes appending exact
(only new prefixes are computed) and lets an edit keep every prefix before it.

Results for odd input: a null text is the empty text with no tokens; a null id stays null; repeated rows
each give a row; other columns of the input are not carried over, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, slices, stage

#: Entries that a worker keeps of each cache of pieces; a full cache starts anew, results stay the same.
CACHE_ENTRIES = 250_000
PREFIX_ENTRIES = 250_000
PAIR_ENTRIES = 400_000
#: Longer pieces take the table instead of recursion.
SHORT_BYTES = 128


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in content.splitlines() if line.strip()}


class PrefixCodec:
    """Encoder and decoder of single pieces (pre-tokens) for one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        #: Token lengths, longest first, for each ending of up to three bytes: where a last token can begin.
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            for n in (1, 2, 3):
                if len(token) == n or len(token) > n == 3:
                    sizes.setdefault(token[-n:], set()).add(len(token))
        self.sizes = {end: tuple(sorted(found | sizes.get(end[1:], set()) | sizes.get(end[2:], set()), reverse=True)) for end, found in sizes.items()}
        #: Last token of each short prefix met so far, shared by all pieces that begin alike.
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain rank-ordered merging; used on joined token pairs only, which are short."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _own(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.vocab[token]) == [self.vocab[token]]
        return known

    def fits(self, first: int, second: int) -> bool:
        """Whether two tokens may stand side by side in an encoding."""
        known = self.pairs.get(first << 32 | second)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            a, b = self.vocab[first], self.vocab[second]
            known = self.pairs[first << 32 | second] = self.merge(a + b) == [a, b]
        return known

    def _sizes(self, prefix: bytes) -> tuple[int, ...]:
        """Lengths that the last token of a prefix can have, longest first."""
        end = prefix[-3:]
        found = self.sizes.get(end) or self.sizes.get(end[-2:]) or self.sizes.get(end[-1:])
        if not found:
            raise ValueError(f"the vocabulary has no token for byte {prefix[-1]}")
        return found

    def last_of(self, prefix: bytes) -> int:
        """The unique token that ends the encoding of a (short) prefix."""
        size_all = len(prefix)
        for size in self._sizes(prefix):
            if size > size_all:
                continue
            begin = size_all - size
            token = self.ranks.get(prefix[begin:])
            if token is None:
                continue
            if begin:
                head = prefix[:begin]
                before = self.prefixes.get(head)
                if before is None:
                    before = self.last_of(head)
                known = self.pairs.get(before << 32 | token)
                if not (self.fits(before, token) if known is None else known):
                    continue
            elif not self._own(token):
                continue
            if len(self.prefixes) >= PREFIX_ENTRIES:
                self.prefixes.clear()
            self.prefixes[prefix] = token
            return token
        raise ValueError(f"no token ends the prefix {prefix!r}")

    def extend(self, piece: bytes, last: list[int], start: int = 0) -> list[int]:
        """Fill the table of last tokens for the prefixes longer than ``start``; ``last[i]`` belongs to prefix i."""
        ranks, pairs, fits = self.ranks, self.pairs, self.fits
        del last[start + 1 :]
        if not last:
            last.append(-1)
        for end in range(start + 1, len(piece) + 1):
            for size in self._sizes(piece[max(0, end - 3) : end]):
                begin = end - size
                token = ranks.get(piece[begin:end]) if begin >= 0 else None
                if token is None:
                    continue
                if begin:
                    known = pairs.get(last[begin] << 32 | token)
                    if fits(last[begin], token) if known is None else known:
                        break
                elif self._own(token):
                    break
            else:
                raise ValueError(f"no token ends the prefix of {end} bytes")
            last.append(token)
        return last

    def ids(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """Token ids of a piece, read backwards from the last tokens of its prefixes."""
        if not piece:
            return []
        if last is None:
            direct = self.ranks.get(piece)
            if direct is not None:
                return [direct]
            if len(piece) > SHORT_BYTES:
                last = self.extend(piece, [])
        out, at, vocab = [], len(piece), self.vocab
        while at:
            if last is None:
                head = piece[:at]
                token = self.prefixes.get(head)
                if token is None:
                    token = self.last_of(head)
            else:
                token = last[at]
            out.append(token)
            at -= len(vocab[token])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


class Buffer:
    """One piece that grows or is edited; the stored prefixes make both exact and cheap."""

    def __init__(self, codec: PrefixCodec, piece: bytes = b""):
        self.codec, self.piece = codec, piece
        self.last = codec.extend(piece, [])

    def append(self, data: bytes) -> list[int]:
        start = len(self.piece)
        self.piece += data
        self.codec.extend(self.piece, self.last, start)
        return self.ids()

    def edit(self, at: int, removed: int, data: bytes) -> list[int]:
        """Replace ``removed`` bytes at ``at``: prefixes up to ``at`` are kept, the rest is computed anew."""
        self.piece = self.piece[:at] + data + self.piece[at + removed :]
        self.codec.extend(self.piece, self.last, at)
        return self.ids()

    def ids(self) -> list[int]:
        direct = self.codec.ranks.get(self.piece)
        return [direct] if direct is not None else self.codec.ids(self.piece, self.last)


class _Pieces(dict):
    """Packed ids (little-endian unsigned 32-bit) of words, with a prefix put before each."""

    def __init__(self, encoder: TextEncoder, prefix: str):
        super().__init__()
        self.encoder, self.prefix = encoder, prefix

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = self.encoder.pack(self.prefix + word)
        return found


class TextEncoder:
    """Encodes whole texts: splits by the pattern, encodes each match on its own.

    A space before a visible character always opens a match, and a line feed between visible characters
    is one, so text whose white space is single spaces and line feeds is cut there first and encoded
    word by word from a cache. Any other text takes the pattern from end to end.
    """

    #: White space other than space and line feed.
    _rare = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace()) - {" ", "\n"}

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.codec = PrefixCodec(ranks)
        self.pattern = regex.compile(pattern)
        self.plain, self.spaced = _Pieces(self, ""), _Pieces(self, " ")
        self.matches: dict[str, bytes] = {}
        self.line = self.pack("\n")

    def pack(self, text: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(text):
            ids += self.codec.ids(match.encode("utf-8", "surrogatepass"))
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        if not self._simple(text):
            return self._slow(text)
        out: list[bytes] = []
        plain, spaced = self.plain, self.spaced.__getitem__
        for i, row in enumerate(text.split("\n")):
            if i:
                out.append(self.line)
            words = row.split(" ")
            out.append(plain[words[0]])
            out.extend(map(spaced, words[1:]))
        return b"".join(out)

    def _simple(self, text: str) -> bool:
        """Whether all white space is single spaces and line feeds."""
        return "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text and self._rare.isdisjoint(text)

    def _slow(self, text: str) -> bytes:
        out, known = [], self.matches
        for match in self.pattern.findall(text):
            packed = known.get(match)
            if packed is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                ids = self.codec.ids(match.encode("utf-8", "surrogatepass"))
                packed = known[match] = np.array(ids, dtype="<u4").tobytes()
            out.append(packed)
        return b"".join(out)

    def forget(self) -> None:
        """Drop the pieces met so far; the worker process may serve other operators next."""
        for cache in (self.plain, self.spaced, self.matches, self.codec.prefixes):
            cache.clear()

    def decode(self, packed: bytes) -> bytes:
        return self.codec.decode(np.frombuffer(packed, dtype="<u4").tolist())


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder_of(content: bytes, pattern: str) -> TextEncoder:
    """The worker's encoder for a rank file; made once for each Python process."""
    key = hashlib.sha256(content).hexdigest(), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(read_ranks(content), pattern)
    return _ENCODERS[key]


def vocabulary(path: str) -> bytes:
    """A rank file's content; its size does not depend on the data."""
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``id_col`` and ``ids`` (packed little-endian unsigned 32-bit token ids) for each row.

    No shuffle; the rank file (bounded by the vocabulary) is broadcast.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for part in slices(batches):
            packed = [encoder.encode(text) if text else b"" for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=[id_col, "ids"])
        encoder.forget()

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(stage(run), f"`{id_col}` long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Columns ``id_col``, ``ids`` and ``decoded`` (the bytes that the ids stand for); null ids decode to no bytes."""
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for part in slices(batches):
            decoded = [encoder.decode(packed) if packed else b"" for packed in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(decoded, pa.binary())], names=[id_col, "ids", "decoded"])

    return encoded.select(id_col, "ids").mapInArrow(stage(run), f"`{id_col}` long, ids binary, decoded binary")


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and hex digests of the ids and of the decoded bytes."""
    ids = F.coalesce("ids", F.lit(b""))
    return decoded.select(
        F.col(id_col),
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
