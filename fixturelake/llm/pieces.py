"""Encoding into sentence pieces that keeps offsets, and decoding.

A text is normalised first: at each place the longest prefix that the model's compiled character map knows (a double-array trie over UTF-8
bytes) is replaced, everything else is copied, and every replacement is recorded with its source bytes. The normalised text is cut
where no piece of the vocabulary can lie across: before a space that follows another character, and around characters that no piece
holds. Each part is merged pair by pair, best score first, and characters without a piece become byte pieces; parts met before
are looked up. A piece's bytes in the normalised text are then projected through the recorded alignment to bytes of the original.

Parts are taken one after the other, so that a long text needs no more memory than its ids. A run without any such cut is merged as one
part, in time that grows a little faster than its length.

Null and empty texts have no pieces. Strings of control pieces in a text are ordinary text, as in the library. Null ids are kept, rows that
repeat give repeated results, an empty table gives no rows, and extra columns are ignored. Models have to be of merged pieces with byte
fallback and without pieces defined by a user; others are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, small_batches, table
from .tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Parts that a worker remembers, and the longest of them in characters.
MEMO, SHORT = 400_000, 40
#: Characters of a text that are taken at once.
STEP = 1 << 19
# Kinds of pieces, and of models, in the model's file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: numbers as they are, the rest as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, blob[at : at + size]
            at += size


class CharacterMap:
    """A compiled map from prefixes to replacements: a double-array trie in 32-bit units, and the replacements, each ended by a zero."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]
        self.first = {b for b in range(1, 256) if self.units and self._step(self._offset(0), b) is not None}

    def _offset(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10 << ((unit & 512) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        base, found = self._offset(0), None
        for k in range(at, len(data)):
            node = self._step(base, data[k])
            if node is None:
                break
            base = self._offset(node)
            if self.units[node] >> 8 & 1:
                value = self.units[base] & 0x7FFFFFFF
                found = k + 1 - at, value
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


class Alignment:
    """Where bytes of a normalised text come from: runs (normalised start, source start, whether copied)."""

    def __init__(self) -> None:
        self.at, self.source, self.copied = array("q"), array("q"), bytearray()

    def add(self, at: int, source: int, copied: bool) -> None:
        self.at.append(at)
        self.source.append(source)
        self.copied.append(copied)

    def cut(self, length: int) -> int:
        """Leave out what lies behind ``length``; the source place of the first byte left out."""
        k = bisect_right(self.at, length) - 1
        source = self.source[k] + (length - self.at[k] if self.copied[k] else 0)
        while self.at and self.at[-1] >= length:
            self.at.pop()
            self.source.pop()
            self.copied.pop()
        return source

    def project(self, places: np.ndarray) -> np.ndarray:
        """Source bytes of rising normalised places; each byte of a replacement comes from where its prefix begins."""
        at, source = np.frombuffer(self.at, np.int64), np.frombuffer(self.source, np.int64)
        run = np.searchsorted(at, places, "right") - 1
        return source[run] + np.where(np.frombuffer(bytes(self.copied), bool)[run], places - at[run], 0)


class Model:
    def __init__(self, blob: bytes) -> None:
        pieces, trainer, self.prefix, self.squeeze, self.escape = [], {}, True, True, True
        chars = b""
        for field, value in _fields(blob):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                spec = {2: b"", 3: 1, 4: 1, 5: 1} | dict(_fields(value))
                chars, self.prefix, self.squeeze, self.escape = spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5])
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces) or not self.escape:
            raise ValueError("the model has to be of merged pieces with byte fallback and escaped spaces, without user-defined or unused pieces or spaces as suffixes")
        self.kinds, self.names = [k for _, _, k in pieces], [p for p, _, _ in pieces]
        self.map = CharacterMap(chars)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        # what each piece stands for; a sign counts as the space that it replaces
        self.texts = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.sizes = [len(t) for t in self.texts]
        self.plain = {p: (struct.pack("=i", self.sizes[i]), str(i)) for p, i in self.ids.items()}
        self.byte = {i: b for b, i in self.bytes.items()}
        scores = {p: s for p, s, k in pieces if k == NORMAL}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}
        # where no piece holds a space behind another character, parts begin there; characters without a piece stand alone
        self.known = "".join(sorted({c for p in self.ids for c in p} - {SPACE}))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        letters = f"[{re.escape(self.known)}]"
        self.parts = re.compile(f"[{re.escape(self.known)}{SPACE}]+|." if inner else f"{SPACE}*{letters}+|{SPACE}+|.", re.DOTALL)
        # places where prefixes of the map, or spaces and their sign, may begin
        self.special = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in sorted(self.map.first | {0x20, 0xE2})) + b"]") if self.map.units or self.squeeze else re.compile(SPACE.encode())
        self.apart = not inner
        self.memo: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def normalised(self, text: str) -> tuple[str, Alignment]:
        """The text as pieces see it, with a plain space for each sign of one, and its alignment in bytes."""
        data, signs = text.encode(), SPACE.encode()
        out, align, n, at, copied = [], Alignment(), 0, 0, 0
        if not data:
            return "", align

        def prefix(k: int) -> tuple[int, bytes] | None:
            return self.map.longest(data, k) if self.map.units and data[k] in self.map.first else None

        def put(piece: bytes, source: int, as_is: bool) -> None:
            nonlocal n
            if piece:
                align.add(n, source, as_is)
                out.append(piece)
                n += len(piece)

        begun = 0
        while self.squeeze and begun < len(data):
            size, got = prefix(begun) or (1, data[begun : begun + 1])
            if got != b" ":
                break
            begun += size
        if begun == len(data):
            return "", align
        if self.prefix:
            put(b" ", begun, False)
        after_space = self.squeeze
        at = copied = begun
        while at < len(data):
            place = self.special.search(data, at)
            stop = place.start() if place else len(data)
            if stop > at:
                after_space = False
            if not place:
                break
            hit = prefix(stop)
            if hit is None and data[stop : stop + 3] == signs:
                hit = 3, b" "
                spaces = False  # a sign in the text is no space to be squeezed
            elif hit is None and data[stop : stop + 1] == b" " and self.squeeze:
                hit = 1, b" "
                spaces = True
            else:
                spaces = True
            if hit is None:
                # nothing known begins here: one character is copied
                at = stop + (1 if data[stop] < 0x80 else 2 if data[stop] < 0xE0 else 3 if data[stop] < 0xF0 else 4)
                after_space = False
                continue
            put(data[copied:stop], copied, True)
            size, got = hit
            if after_space and spaces:
                got = got.lstrip(b" ")
            put(got.replace(signs, b" "), stop, False)
            if got:
                after_space = self.squeeze and spaces and got.endswith(b" ")
            at = copied = stop + size
        put(data[copied:], copied, True)
        whole = b"".join(out)
        end = len(data)
        if self.squeeze:
            kept = len(whole.rstrip(b" "))
            if kept < len(whole):
                end = align.cut(kept)
                whole = whole[:kept]
        align.add(len(whole), end, False)
        return whole.decode(), align

    def merged(self, part: str) -> list[str]:
        """The pieces of a part, with signs for spaces: adjacent pairs are merged, best score first, the left one of equals."""
        rank, symbols = self.rank, list(part)
        n = len(symbols)
        if n <= SHORT:
            ranks = [rank.get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
            while ranks and (best := min(ranks)) < _NEVER:
                k = ranks.index(best)
                symbols[k] += symbols.pop(k + 1)
                del ranks[k]
                if k:
                    ranks[k - 1] = rank.get(symbols[k - 1] + symbols[k], _NEVER)
                if k < len(ranks):
                    ranks[k] = rank.get(symbols[k] + symbols[k + 1], _NEVER)
            return symbols
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        # a pair is its rank and place in one number
        waiting = [r << 40 | k for k in range(n - 1) if (r := rank.get(symbols[k] + symbols[k + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            top = heapq.heappop(waiting)
            k = top & 0xFFFFFFFFFF
            j = after[k]
            if j >= n or not symbols[k]:
                continue
            both = symbols[k] + symbols[j]
            if rank.get(both) != top >> 40:
                continue  # one of the two has been merged since
            symbols[k], symbols[j] = both, ""
            j = after[k] = after[j]
            if j < n:
                before[j] = k
                if (r := rank.get(both + symbols[j])) is not None:
                    heapq.heappush(waiting, r << 40 | k)
            i = before[k]
            if i >= 0 and (r := rank.get(symbols[i] + both)) is not None:
                heapq.heappush(waiting, r << 40 | i)
        return [s for s in symbols if s]

    def coded(self, part: str) -> tuple[array, array]:
        """Ids of a part, and the bytes of each in the normalised text; of a character's byte pieces the last has them all."""
        ids, sizes, own = array("i"), array("i"), self.ids
        for piece in self.merged(part):
            if piece in own:
                i = own[piece]
                ids.append(i)
                sizes.append(self.sizes[i])
            else:
                raw = piece.encode()
                ids.extend(self.bytes[b] for b in raw)
                sizes.extend([0] * (len(raw) - 1))
                sizes.append(len(raw))
        return ids, sizes

    def part(self, part: str) -> tuple[bytes, str, bytes]:
        """Of one part: sizes, ids as text, decoded text."""
        got = self.before.get(part)
        if got is None:
            try:  # most parts have a piece for each of their characters
                rows = [self.plain[p] for p in self.merged(part)]
                got = b"".join([r[0] for r in rows]), ",".join([r[1] for r in rows]), part.replace(SPACE, " ").encode()
            except KeyError:
                ids, sizes = self.coded(part)
                got = sizes.tobytes(), ",".join(map(str, ids)), self.joined(ids)
        if len(part) <= SHORT:
            if len(self.memo) >= MEMO:  # what is met often is found in the older half and moves on
                self.before, self.memo = self.memo, {}
            self.memo[part] = got
        return got

    def parts_of(self, normal: str) -> Iterator[list[tuple[bytes, str, bytes]]]:
        """The parts of a normalised text in lists, each of about STEP characters where there is a space to cut at."""
        text, at = normal.replace(" ", SPACE), 0
        while at < len(text):
            end = text.find(SPACE, at + STEP) if self.apart else -1
            while end > 0 and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            end = len(text) if end < 0 else end
            names = self.parts.findall(text, at, end)
            yield [got or self.part(name) for name, got in zip(names, map(self.memo.get, names), strict=True)]
            at = end

    def joined(self, ids) -> bytes:
        """The bytes of some pieces, spaces for their signs; control pieces have none. Byte pieces are read as characters in runs."""
        texts, byte = self.texts, self.byte
        if byte.keys().isdisjoint(ids):
            return b"".join([texts[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in byte:
                run.append(byte[i])
                continue
            if run:
                out.append(_characters(run))
                run = bytearray()
            out.append(texts[i])
        return b"".join([*out, _characters(run)])

    def lead(self, ids) -> int:
        """How many signs at the beginning stand for no space: the one that the encoder puts first; where spaces are squeezed, one of each piece
        before the first text."""
        n = 0
        if self.prefix or self.squeeze:
            for i in ids:
                if self.kinds[i] == NORMAL and self.names[i].startswith(SPACE):
                    n += 1
                    if self.squeeze and len(self.names[i]) == 1:
                        continue
                elif self.kinds[i] == CONTROL:
                    continue
                break
        return n

    def decode(self, ids) -> str:
        """The text of some ids."""
        ids = list(ids)
        return self.joined(ids)[self.lead(ids) :].decode()

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a text, with the first byte and the end of each piece in the original."""
        normal, align = self.normalised(text)
        ids, sizes = [], []
        for found in self.parts_of(normal):
            sizes += [x[0] for x in found]
            ids += [x[1] for x in found]
        ends = np.cumsum(np.frombuffer(b"".join(sizes), np.int32), dtype=np.int64)
        if not len(ends):
            return ends, ends, ends
        bounds = align.project(np.concatenate([[0], ends]))
        # byte pieces before a character's last are empty at its beginning
        return np.array(",".join(ids).split(","), np.int64), bounds[:-1], bounds[1:]

    def digest(self, text: str) -> tuple[int, str, str, int]:
        """Number of ids, SHA-256 of the ids joined by commas and of the decoded text, and the source bytes that the pieces' spans cover."""
        if not text:
            return 0, _EMPTY, _EMPTY, 0
        normal, align = self.normalised(text)
        ids, decoded, n, covered, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for found in self.parts_of(normal):
            sizes = np.frombuffer(b"".join([x[0] for x in found]), np.int32)
            named = ",".join([x[1] for x in found])
            skip = 0 if n else self.lead(int(m[0]) for m in re.finditer("[0-9]+", named))
            ids.update(((b"," if n else b"") + named.encode()))
            decoded.update(b"".join([x[2] for x in found])[skip:])
            bounds = align.project(size + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            n, covered, size = n + len(sizes), covered + int((bounds[1:] - bounds[:-1]).sum()), size + int(sizes.sum(dtype=np.int64))
        return n, ids.hexdigest(), decoded.hexdigest(), covered


_NEVER = 1 << 62
_EMPTY = hashlib.sha256(b"").hexdigest()


def _characters(run: bytes) -> bytes:
    """A run of byte pieces as UTF-8, each byte that begins no character as U+FFFD."""
    if not run:
        return b""
    try:
        bytes(run).decode()
        return bytes(run)
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    bytes(run[at : at + size]).decode()
                except UnicodeDecodeError:
                    continue
                out.append(bytes(run[at : at + size]))
                at += size
                break
            else:
                out.append("�".encode())
                at += 1
        return b"".join(out)


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            out = [own.digest(t or "") for t in b.column("text").to_pylist()]
            kinds = pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"])

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            out = [own.encode(t or "") for t in b.column("text").to_pylist()]
            lists = [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists], ["doc_id", "ids", "begins", "ends"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in batches:
            texts = [None if x is None else own.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def _over_texts(docs: DataFrame, run, schema: str) -> DataFrame:
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends: the pieces of each text, and their bytes in it."""
    return _over_texts(docs, _encoded(path or vocabulary_path(MODEL)), "doc_id long, ids array<long>, begins array<long>, ends array<long>")


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids; null where there are none."""
    ship(coded.sparkSession)
    return coded.select("doc_id", F.col("ids").cast("array<long>").alias("ids")).mapInArrow(_decoded(path or vocabulary_path(MODEL)), "doc_id long, text string")


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered (source bytes in the pieces' spans) of each text, without writing the ids out."""
    return _over_texts(docs, _digests(path or vocabulary_path(MODEL)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
