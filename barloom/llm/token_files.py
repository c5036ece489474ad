"""Token ids in binary files, packed by a Re-Pair grammar for each block of ids.

Writing: documents are range-partitioned and sorted by id; a task encodes whole texts, ends each document
with ``END`` and packs every ``BLOCK`` ids by a grammar of its own. A round counts adjacent pairs of symbols,
takes the most frequent ones (never across the end of a document), gives each a nonterminal and replaces
its occurrences; where two of them overlap, the more frequent pair wins. Rounds go on until no pair is
frequent or little is saved. The path of a file joins the manifest only when its task has ended well, so files
of lost or repeated attempts are never read.

File: blocks, then a footer, all little-endian. A block holds its counts (ids, symbols, rules, bytes of a
symbol), the rules' left and right symbols and expansion lengths, the symbols, and the id offset of every
``SAMPLE``-th symbol; so the ids at any place are decoded from one sample onwards. The footer holds the byte and
id offset of each block and the id offset and length of each document; its own place is in the last 8 bytes.

Texts are cut where a byte-level BPE tokenizer cuts them anyway (``cuts``). Equal pieces are encoded once in a task;
pieces that are new go to the tokenizers library together.

Defined cases: a null or empty text is the end id alone; a null doc_id sorts first; rows of the same doc_id go by
a hash of their text and each keeps its own ids; an empty table gives no files and an empty result;
further columns are not read. A text of any length passes in parts and may run over many blocks.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, stage
from .words import text_bytes

END = 0
BLOCK = 1 << 21       # ids of a grammar
FILE = 1 << 24        # ids of a file, or one document
SAMPLE = 256          # symbols between two sampled offsets
LEAST = 12            # occurrences that make a pair worth a rule: a rule takes 12 bytes, a symbol 2
PAIRS = 8192          # pairs replaced in a round
PIECES = 1_500_000    # encoded pieces a task remembers, about
PART = 1 << 20        # bytes of text encoded at once
TOKENIZER_BYTES = 64 << 20
READERS = 20_000      # tasks that read files back, at most
_HEAD, _TAIL = "<4sIIIIII", "<4sII"
_VISIBLE = np.zeros(256, bool)    # ASCII
_VISIBLE[33:127] = True
_LEAD2 = np.zeros(256, bool)      # first bytes of characters of two and three bytes none of which is white space
_LEAD2[0xC3:0xE0] = True
_LEAD3 = np.zeros(256, bool)
_LEAD3[[0xE0, *range(0xE4, 0xEE)]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789", *range(65, 91), *range(97, 123)]] = True
_PLAIN = _ALNUM.copy()            # bytes of letters and digits up to U+07FF
_PLAIN[0x80:0xC0] = _PLAIN[0xC3:0xE0] = True
_RANDOM = np.random.default_rng(20_260_311)
_VALUES = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cuts(data: np.ndarray) -> np.ndarray:
    """True where a piece may begin: before white space after a visible character, after a single line end,
    and between a letter or digit and a mark."""
    visible = _VISIBLE[data]
    after = np.zeros(len(data), bool)  # the character before is visible
    after[1:] = visible[:-1]
    late = data >= 0x80
    after[2:] |= late[1:-1] & _LEAD2[data[:-2]]
    after[3:] |= late[2:-1] & late[1:-2] & _LEAD3[data[:-3]]
    line = data == 10
    out = _WHITE[data] & after
    out[1:] |= line[:-1] & after[:-1] & visible[1:]
    out[1:] |= _ALNUM[data[:-1]] & _MARK[data[1:]]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class Encoder:
    """Whole texts to ids. Equal pieces, known by two 64-bit hashes, go to the library once.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is Spark's
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_str(tokenizer)
        self.vocabulary = self._tokenizer.get_vocab_size()
        self._line = self._encode(["\n"])[0]
        self._powers: list[np.ndarray] = []
        self._forget()

    def _forget(self) -> None:
        self._hash, self._check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self._begin, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._store, self._held = np.array([END], np.uint32), 1  # END first

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, np.uint32) for c in self._tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _hashes(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        if not self._powers or len(self._powers[0]) < len(data):
            n = max(len(data), PART + PART // 2)
            self._powers = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))
                            for b in _BASES for x in (b, pow(b, -1, 1 << 64))]
        out = []
        for k in (0, 1):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[k][data] * self._powers[2 * k][:len(data)])))
            out.append(_mix((sums[end] - sums[begin]) * self._powers[2 * k + 1][begin]))
        return out

    def _find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size in the store of each piece's ids; new pieces are encoded first."""
        h, check = self._hashes(data, begin, end)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        new = first[~np.isin(distinct, self._hash, assume_unique=True)]
        if len(self._hash) + len(new) > PIECES and len(self._hash):
            self._forget()
            new = first
        if len(new):
            at = np.searchsorted(self._hash, h[new])
            place, size = self._keep(data, begin[new], end[new])
            self._hash, self._check = np.insert(self._hash, at, h[new]), np.insert(self._check, at, check[new])
            self._begin, self._size = np.insert(self._begin, at, place), np.insert(self._size, at, size)
        number = np.searchsorted(self._hash, distinct)[which]
        place, size = self._begin[number], self._size[number]
        other = np.flatnonzero(self._check[number] != check)  # another piece of the same hash
        if len(other):
            place[other], size[other] = self._keep(data, begin[other], end[other])
        return place, size

    def _keep(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces into the store: their places and sizes.

        Lone words go together, as lines of one text: a line end before a word is a token of its own.
        """
        odd = np.concatenate((np.zeros(1, np.int32), np.cumsum(~_PLAIN[data], dtype=np.int32)))
        spaced = data[begin] == 32
        lone = (odd[end] == odd[begin] + spaced) & (end - begin > spaced)
        place, size = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        raw = data.tobytes()
        together = np.flatnonzero(lone)
        if len(together) and len(self._line) == 1:
            ids, = self._encode([b"\n".join([raw[b:e] for b, e in zip(begin[together].tolist(), end[together].tolist())]).decode()])
            edge = np.flatnonzero(ids == self._line[0])
            if len(edge) == len(together) - 1:
                first = np.append(0, edge + 1)
                place[together], size[together] = first + self._stored(ids), np.append(edge, len(ids)) - first
        rest = np.flatnonzero(size == 0)
        if len(rest):
            ids = self._encode([raw[b:e].decode("utf-8", "replace") for b, e in zip(begin[rest].tolist(), end[rest].tolist())])
            size[rest] = [len(x) for x in ids]
            place[rest] = self._stored(np.concatenate(ids)) + np.cumsum(size[rest]) - size[rest]
        return place, size

    def _stored(self, ids: np.ndarray) -> int:
        at = self._held
        self._held += len(ids)
        if self._held > len(self._store):
            self._store = np.concatenate((self._store, np.zeros(self._held, np.uint32)))
        self._store[at:self._held] = ids
        return at

    def slices(self, texts):
        """(ids, ends) in turn, over texts as bytes: ids of texts, ``END`` after each, and the places of these ends."""
        held, size, ends, wanted = [], 0, [], PART
        for text in texts:
            for at in range(0, max(1, len(text)), PART):
                held.append(text[at:at + PART])
                size += len(held[-1])
                done = at + PART >= len(text)
                if done:
                    ends.append(size)
                if size >= wanted:
                    rest, found = self._slice(b"".join(held), ends, not done)
                    if found:
                        yield found
                    held, size, ends = [rest], len(rest), []
                    wanted = max(PART, 2 * size)
        if ends:
            yield self._slice(b"".join(held), ends, False)[1]

    def _slice(self, raw: bytes, ends: list[int], unfinished: bool):
        """(the unfinished last piece, (ids, ends))."""
        data = np.frombuffer(raw, np.uint8)
        first = cuts(data)
        stops = np.array(ends, np.int64)
        first[:1] = True
        first[stops[stops < len(data)]] = True
        begin = np.flatnonzero(first)
        end = np.append(begin[1:], len(data))[:len(begin)]
        rest = b""
        if unfinished and len(begin) and (not ends or begin[-1] >= ends[-1]):
            rest, begin, end = raw[begin[-1]:], begin[:-1], end[:-1]
        if not len(begin) and not ends:
            return rest, None
        place, size = self._find(data, begin, end) if len(begin) else (begin, begin)
        at = np.searchsorted(begin, stops, side="left")
        place, size = np.insert(place, at, 0), np.insert(size, at, 1)
        total = np.cumsum(size)
        ids = self._store[np.repeat(place - total + size, size) + np.arange(int(size.sum()))]
        return rest, (ids, total[at + np.arange(len(at))] - 1)


def grammar(ids: np.ndarray, last: np.ndarray, base: int, *, least: int = LEAST, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule r is the pair of symbols that ``base`` + r stands for.

    ``last`` marks the ids that end a document; no pair begins there. A round counts hashed pairs and takes
    one pair for each of the fullest of 2^20 buckets; pairs that share its bucket wait for a later round.
    """
    s, last = ids.astype(np.int32), last.copy()
    rules: list[int] = []
    room = (1 << 16) - base if base < 1 << 16 else 1 << 20  # symbols stay in two bytes where ids do
    while len(s) > 1 and len(rules) < room:
        key = s[:-1].astype(np.int64) << 32 | s[1:]
        bucket = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
        bucket[last[:-1]] = 1 << 20
        many = np.bincount(bucket, minlength=(1 << 20) + 1)
        many[1 << 20] = 0
        busy = np.flatnonzero(many >= least)
        if len(busy) > pairs:
            busy = busy[np.argpartition(many[busy], -pairs)[-pairs:]]
        which = np.full((1 << 20) + 1, -1, np.int32)  # number of the pair taken for a bucket
        which[busy] = np.arange(len(busy))
        which = which[bucket]
        at = np.flatnonzero(which >= 0)
        which, key = which[at], key[at]
        taken = np.zeros(len(busy), np.int64)
        taken[which] = key
        same = np.flatnonzero(taken[which] == key)
        at, which = at[same], which[same]
        # A run of one symbol is full of overlapping pairs: every other one counts.
        run = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(which) != 0)))[:len(at)])
        even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
        at, which = at[even], which[even]
        weight = np.zeros(len(s) + 2, np.int32)  # at i + 1: how often the pair that begins at i occurs
        weight[at + 1] = np.bincount(which, minlength=len(busy))[which]
        wins = (weight[at + 1] > weight[at]) & (weight[at + 1] >= weight[at + 2])
        used = np.bincount(which[wins], minlength=len(busy))
        new = np.flatnonzero(used >= least)
        new = new[np.argsort(-used[new], kind="stable")][:room - len(rules)]
        number = np.full(len(busy), -1, np.int32)
        number[new] = base + len(rules) + np.arange(len(new))
        rules += taken[new].tolist()
        number = number[which]
        at, number = at[wins & (number >= 0)], number[wins & (number >= 0)]
        s[at] = number
        last[at] = last[at + 1]
        kept = np.ones(len(s), bool)
        kept[at + 1] = False
        s, last = s[kept], last[kept]
        if len(at) * 32 < len(s):
            break
    found = np.array(rules, np.int64)
    return s, np.column_stack((found >> 32, found & 0xFFFFFFFF))


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size = np.ones(len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        size[r] = (size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1)
    return size


def pack(ids: np.ndarray, last: np.ndarray, base: int) -> bytes:
    """A block."""
    symbols, rules = grammar(ids, last, base)
    size = _lengths(rules, base)
    each = np.where(symbols >= base, size[np.maximum(symbols - base, 0)] if len(size) else 1, 1)
    offset = np.cumsum(each) - each
    width = 2 if base + len(rules) <= 1 << 16 and int(ids.max(initial=0)) < 1 << 16 else 4
    return b"".join((struct.pack(_HEAD, b"RePr", len(ids), len(symbols), len(rules), width, base, SAMPLE), rules[:, 0].astype("<u4").tobytes(),
                     rules[:, 1].astype("<u4").tobytes(), size.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
                     offset[::SAMPLE].astype("<u4").tobytes()))


def unpack(block: bytes, start: int = 0, count: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block (all by default), from the nearest sampled symbol."""
    _, n, n_symbols, n_rules, width, base, every = struct.unpack_from(_HEAD, block)
    at = struct.calcsize(_HEAD)
    left, right, size = np.frombuffer(block, "<u4", 3 * n_rules, at).astype(np.int64).reshape(3, n_rules)
    at += 12 * n_rules
    symbols = np.frombuffer(block, f"<u{width}", n_symbols, at)
    samples = np.frombuffer(block, "<u4", -(-n_symbols // every), at + width * n_symbols)
    stop = n if count is None else min(n, start + count)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first = int(np.searchsorted(samples, start, side="right")) - 1
    end = int(np.searchsorted(samples, stop, side="left"))
    part = symbols[first * every:end * every].astype(np.int64)
    # Expansions of all rules in one table, in the order of the rules.
    begin = np.cumsum(size) - size
    table = np.zeros(int(size.sum()), np.uint32)
    for r, (a, b, p) in enumerate(zip(left.tolist(), right.tolist(), begin.tolist())):
        for x in (a, b):
            if x < base:
                table[p] = x
                p += 1
            else:
                q, m = int(begin[x - base]), int(size[x - base])
                table[p:p + m] = table[q:q + m]
                p += m
    rule = part >= base
    each, source = np.ones(len(part), np.int64), np.arange(len(part)) + len(table)
    each[rule], source[rule] = size[part[rule] - base], begin[part[rule] - base]
    offset = np.cumsum(each) - each
    place = np.repeat(source - offset, each) + np.arange(int(each.sum()))
    skip = start - int(samples[first])
    return np.concatenate((table, part.astype(np.uint32)))[place[skip:skip + stop - start]]


class Writer:
    """One file: slices of ids are added as they come, ``close`` writes the footer."""

    def __init__(self, out, base: int):
        self._out, self._base, self._place = out, base, 0
        self._ids, self._last, self._held = [], [], 0
        self._blocks, self._docs = [], []
        self.ids = self.documents = self._begun = 0

    def add(self, ids: np.ndarray, ends: np.ndarray, keys: list) -> None:
        """Ids with the places of the last id of each document that ends here, and the documents' ids."""
        last = np.zeros(len(ids), bool)
        last[ends] = True
        for key, end in zip(keys, (self.ids + ends + 1).tolist()):
            self._docs.append((key or 0, self._begun, end - self._begun, key is None))
            self._begun = end
        self._ids.append(ids)
        self._last.append(last)
        self.ids += len(ids)
        self._held += len(ids)
        self.documents += len(keys)
        if self._held >= BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids, last = np.concatenate(self._ids), np.concatenate(self._last)
        at = 0
        while len(ids) - at >= least:
            block = pack(ids[at:at + BLOCK], last[at:at + BLOCK], self._base)
            self._blocks.append((self._place, self.ids - self._held + at))
            self._out.write(block)
            self._place += len(block)
            at += min(BLOCK, len(ids) - at)
            if at == len(ids):
                break
        self._ids, self._last, self._held = [ids[at:]], [last[at:]], len(ids) - at

    def close(self) -> int:
        """Bytes of the file."""
        if self._held:
            self._flush(1)
        docs = np.array(self._docs, "<i8").reshape(-1, 4)
        blocks = np.array([*self._blocks, (self._place, self.ids)], "<i8")
        self._out.write(blocks.tobytes() + docs.tobytes() + struct.pack(_TAIL, b"TkFl", len(blocks), len(docs)))
        self._out.close()
        return self._place


class Reader:
    """Random access to the ids and documents of a file."""

    def __init__(self, path: str):
        files, place = FileSystem.from_uri(path)
        self._in = files.open_input_file(place)
        tail = struct.calcsize(_TAIL)
        size = self._in.size() - tail
        mark, n_blocks, n_docs = struct.unpack(_TAIL, self._in.read_at(tail, size))
        if mark != b"TkFl":
            raise ValueError(f"{path} is no token file")
        foot = 16 * n_blocks + 32 * n_docs
        foot = np.frombuffer(self._in.read_at(foot, size - foot), "<i8")
        self.blocks, self.docs = foot[:2 * n_blocks].reshape(-1, 2), foot[2 * n_blocks:].reshape(-1, 4)
        self.ids = int(self.blocks[-1, 1])
        self._held = None, b""

    def _block(self, b: int) -> bytes:
        if self._held[0] != b:
            at, end = int(self.blocks[b, 0]), int(self.blocks[b + 1, 0])
            self._held = b, self._in.read_at(end - at, at)
        return self._held[1]

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file."""
        stop, out = min(self.ids, start + count), []
        b = int(np.searchsorted(self.blocks[:, 1], start, side="right")) - 1
        while start < stop:
            begin = int(self.blocks[b, 1])
            out.append(unpack(self._block(b), start - begin, min(stop, int(self.blocks[b + 1, 1])) - start))
            start, b = start + len(out[-1]), b + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def documents(self):
        """(doc_id or None, start, ids, part after part) of every document; each block is decoded once."""
        b, ids, begin = -1, np.zeros(0, np.uint32), 0
        for doc_id, start, n, missing in self.docs.tolist():
            def parts(at=start, stop=start + n):
                nonlocal b, ids, begin
                while at < stop:
                    if at >= begin + len(ids):
                        b += 1
                        begin, ids = int(self.blocks[b, 1]), unpack(self._block(b))
                    end = min(stop, begin + len(ids))
                    yield ids[at - begin:end - begin]
                    at = end
            yield None if missing else doc_id, start, parts()

    def close(self) -> None:
        self._in.close()


MANIFEST = "part int, file int, path string, docs long, ids long, bytes long"
_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()),
                             ("bytes", pa.int64())])


def write(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Token files of all documents in ascending order; returns the manifest, one row for each file, with
    ``start``, the number of ids before it.

    ``tokenizer`` is the path of a tokenizers file, read by the driver and broadcast up to ``TOKENIZER_BYTES``.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        saved = f.read()
    if len(saved) > TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is too large to broadcast")
    base = Encoder(saved).vocabulary
    held = spark.sparkContext.broadcast({"tokenizer": saved})
    place = f"{folder or shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

    def write_part(batches):
        files, root = FileSystem.from_uri(place)
        # The broadcast stays with the worker, and so does what its encoder has learnt in earlier tasks.
        encoder = held.value.get("encoder") or held.value.setdefault("encoder", Encoder(held.value["tokenizer"]))
        part, number, out, name = TaskContext.get().partitionId(), 0, None, ""
        keys: deque = deque()  # of texts that are not finished

        def texts():
            for batch in batches:
                for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    keys.append(key)
                    yield text.as_py()

        def closed():
            size = out.close()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                (part, number, name, out.documents, out.ids, size), _MANIFEST_ARROW.types)], schema=_MANIFEST_ARROW)

        for ids, ends in encoder.slices(texts()):
            # A file ends with a document, so one that is full goes on to the first end.
            parts = [(ids, ends)]
            if out is not None and out.ids >= FILE and len(ends):
                cut = int(ends[0]) + 1
                parts = [(ids[:cut], ends[:1]), (ids[cut:], ends[1:] - cut)]
            for k, (ids, ends) in enumerate(parts):
                if k:
                    yield closed()
                    out, number = None, number + 1
                if out is None:
                    if not len(ids):
                        continue
                    if not number:
                        files.create_dir(root, recursive=True)
                    leaf = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
                    name = f"{place}/{leaf}"
                    out = Writer(files.open_output_stream(f"{root}/{leaf}"), base)
                out.add(ids, ends, [keys.popleft() for _ in range(len(ends))])
        if out is not None:
            yield closed()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = stage(ordered.mapInArrow(write_part, MANIFEST))
    held.destroy()
    # One row for each file of FILE ids: a window over all of them holds few, narrow rows.
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""
    def read(batches):
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                source, rows = Reader(path), []
                for key, start, parts in source.documents():
                    n = crc = 0
                    for part in parts:
                        n, crc = n + len(part), zlib.crc32(part.astype("<u4").tobytes(), crc)
                    rows.append((key, first + start, n, crc))
                source.close()
                for at in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at:at + (1 << 14)])],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A row stands for a whole file: a stated number of partitions is not merged for its few bytes.
    files = max(1, min(manifest.count(), READERS))
    return manifest.select("path", "start").repartition(files, "path") \
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
