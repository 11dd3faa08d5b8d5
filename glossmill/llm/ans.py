"""Token ids in a binary format coded by a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all files. A file is a run of independent blocks; a block
codes its ids with interleaved lanes, so that encoder and decoder work on whole lanes at once, and holds checkpoints (the
lane states and the read position at some steps) from which its parts can be decoded in parallel, and a CRC-32 of its ids.

Layout, little-endian. Table file: "GMTB", ids of the alphabet (u32), scale bits (u32), CRC-32 of the frequencies (u32),
the frequencies (u32 each). Block: "GMBK", CRC-32 of the table, ids, lanes, steps between checkpoints, checkpoints, words,
documents, CRC-32 of the ids (u32 each); per document its id (i64), whether it has one (u8) and its length (u64); per
checkpoint its word position (u64) and lane states (u64 each); the words (u32 each).

Files are named after the task attempt and only those that the finished job lists are read, so a lost executor or a
second attempt leaves no trace in the result.

Defined cases: a null text counts as empty and yields the end id alone; null doc_ids come first in order; rows of one doc_id follow each
other in an order fixed by a hash of their ids, so that many of them spread over several files; an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import commit_name, discard, fresh_path, materialize, open_store, prepare, table

END_ID = 1
SCALE_BITS = 18
BLOCK_IDS, LANES, CHECK_STEPS = 1 << 18, 1024, 128
_LOW = np.uint64(1 << 31)


class FrequencyTable:
    """Frequencies that sum to 2**bits, at least one for each id that occurs."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray, bits: int = SCALE_BITS) -> FrequencyTable:
        """Scale the counts; what rounding leaves over goes to or comes from the largest frequencies."""
        total, size = int(counts.sum()), 1 << bits
        if not total:
            freq = np.zeros(max(1, len(counts)), np.int64)
            freq[0] = size
            return cls(freq, bits)
        if np.count_nonzero(counts) > size // 2:
            raise ValueError("more ids than the scale has room for; raise bits")
        freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / total), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        over, k = int(freq.sum()) - size, 0
        while over:
            at = order[k % len(order)]
            step = -min(over, max(0, int(freq[at]) // 2)) if over > 0 else -over
            freq[at] += step
            over += step
            k += 1
        return cls(freq, bits)

    def to_bytes(self) -> bytes:
        return b"GMTB" + struct.pack("<III", len(self.freq), self.bits, self.crc) + self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FrequencyTable:
        n, bits, crc = struct.unpack_from("<III", data, 4)
        found = cls(np.frombuffer(data, "<u4", n, 16).astype(np.int64), bits)
        if data[:4] != b"GMTB" or found.crc != crc:
            raise ValueError("the frequency table is damaged")
        return found


def encode_block(ids: np.ndarray, docs: list[tuple[int | None, int]], freqs: FrequencyTable, lanes: int = LANES, check: int = CHECK_STEPS) -> bytes:
    """One block of these ids; docs: the id and the length of each document, in order."""
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    steps = -(-n // lanes)
    bits = np.uint64(freqs.bits)
    f_all, c_all = freqs.freq[ids], freqs.first[ids]
    limit_all = f_all << np.uint64(63 - freqs.bits)
    state = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        part = slice(t * lanes, min(n, (t + 1) * lanes))
        m = part.stop - part.start
        x, f = state[:m], f_all[part]
        full = x >= limit_all[part]
        out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
        words.append(out)
        written += len(out)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[:m] = (q << bits) + (x - q * f) + c_all[part]
        if t % check == 0:
            marks.append((written, state.copy()))
    words.reverse()
    marks.reverse()
    head = b"GMBK" + struct.pack("<8I", freqs.crc, n, lanes, check, len(marks), written, len(docs), zlib.crc32(ids.astype("<u4").tobytes()))
    listed = np.array([(d or 0, d is not None, k) for d, k in docs], np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u8")])).tobytes()
    checks = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in marks)
    return head + listed + checks + b"".join(w.tobytes() for w in words)


def read_header(data: bytes) -> tuple[dict, np.ndarray]:
    if data[:4] != b"GMBK":
        raise ValueError("not a block")
    head = dict(zip(("table", "ids", "lanes", "check", "marks", "words", "docs", "crc"), struct.unpack_from("<8I", data, 4), strict=True))
    return head, np.frombuffer(data, np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u8")]), head["docs"], 36)


def decode_part(data: bytes, freqs: FrequencyTable, mark: int) -> np.ndarray:
    """The ids from one checkpoint to the next; parts of a block can be decoded apart from each other."""
    head, docs = read_header(data)
    n, lanes, check = head["ids"], head["lanes"], head["check"]
    at = 36 + docs.nbytes
    one = 8 + 8 * lanes
    (word,) = struct.unpack_from("<Q", data, at + mark * one)
    state = np.frombuffer(data, "<u8", lanes, at + mark * one + 8).astype(np.uint64)
    words = np.frombuffer(data, "<u4", head["words"], at + head["marks"] * one).astype(np.uint64)
    mask, bits = np.uint64((1 << freqs.bits) - 1), np.uint64(freqs.bits)
    first, last = mark * check, min(-(-n // lanes), (mark + 1) * check)
    out = np.empty(max(0, min(n, last * lanes) - first * lanes), np.uint32)
    for t in range(first, last):
        m = min(n, (t + 1) * lanes) - t * lanes
        x = state[:m]
        slot = x & mask
        s = freqs.symbol[slot]
        out[(t - first) * lanes : (t - first) * lanes + m] = s
        x = freqs.freq[s] * (x >> bits) + slot - freqs.first[s]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << np.uint64(32)) | words[word : word + len(low)]
        word += len(low)
        state[:m] = x
    end = struct.unpack_from("<Q", data, at + (mark + 1) * one)[0] if mark + 1 < head["marks"] else head["words"]
    then = np.frombuffer(data, "<u8", lanes, at + (mark + 1) * one + 8) if mark + 1 < head["marks"] else np.full(lanes, _LOW)
    if word != end or (state != then).any():
        raise ValueError("a part doesn't end where the next begins")
    return out


def decode_block(data: bytes, freqs: FrequencyTable) -> np.ndarray:
    head, _ = read_header(data)
    if head["table"] != freqs.crc:
        raise ValueError("the block belongs to another frequency table")
    parts = [decode_part(data, freqs, k) for k in range(head["marks"])]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != head["crc"]:
        raise ValueError("a block's checksum doesn't match its ids")
    return ids


#: The steps of a tokenizer that drops white space and lets no word see its neighbours, so that a text's ids are those of its words, one after another.
_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class Words:
    """The library's ids of words, kept by the words themselves, which Arrow compares in full.

    A word of lower-case Latin-1 letters alone passes the normalizer unchanged and the split as one piece, so that only the library's last two
    steps are called for it: the byte signs, asked for once for each letter, and the model. Signs behind such a word are a piece of their own.
    """

    #: Lower-case letters, then signs other than the apostrophe.
    _PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)").fullmatch

    def __init__(self, tokenizer, width: str, most: int, longest: int):
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.width, self.most, self.longest = tokenizer, width, most, longest
        signs = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.signs = {c: signs(chr(c))[0][0] for c in range(0xDF, 0x100) if chr(c).islower()}
        self.runs: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.size, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.width)

    def _encode(self, word: str) -> list[int]:
        plain = self._PLAIN(word)
        if plain is None:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        letters, run = plain.groups()
        ids = [t.id for t in self.tokenizer.model.tokenize(letters if letters.isascii() else letters.translate(self.signs))]
        if run and run not in self.runs:
            if len(self.runs) >= 10_000:
                self.runs.clear()
            self.runs[run] = self.tokenizer.encode(run, add_special_tokens=False).ids
        return ids + self.runs[run] if run else ids

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of each word's ids, and the ids that these lie in. words: distinct."""
        if len(self.known) > self.most:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy()
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if len(self.known):
            begin, size = self.begin[at], self.size[at]
        if not len(new):
            return begin, size, self.flat
        strange = words.take(pa.array(new))
        ids = list(map(self._encode, strange.to_numpy(zero_copy_only=False).tolist()))
        size[new] = np.fromiter(map(len, ids), np.int64, len(ids))
        begin[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), self.width)])
        # Long words are used here and forgotten.
        short = new[pc.less_equal(pc.utf8_length(strange), self.longest).to_numpy(zero_copy_only=False)]
        self.known = pa.concat_arrays([self.known, words.take(pa.array(short))])
        self.begin, self.size = np.concatenate([self.begin, begin[short]]), np.concatenate([self.size, size[short]])
        if len(short) == len(new):
            self.flat = flat
        else:
            place = np.concatenate([np.arange(b, b + n) for b, n in zip(begin[short], size[short], strict=True)]) if len(short) else np.zeros(0, np.int64)
            self.begin[len(self.begin) - len(short) :] = len(self.flat) + np.cumsum(size[short]) - size[short]
            self.flat = np.concatenate([self.flat, flat[place]])
        return begin, size, flat


class TextEncoder:
    """The library's ids of whole texts.

    Every id comes from the library's own encode(). Where the vocabulary file's normalizer and pre-tokenizer are those of _BY_WORDS, and no
    added token holds or eats white space, a text is cut at blanks and newlines, and a word's ids are remembered under the word
    itself, as long as it is short. Texts of Latin-1 are put in lower case before, as that tokenizer does in any case, so that
    fewer words are told apart. Any other file's texts go to the library whole.
    """

    #: Words that are remembered, the longest of them, and characters that are cut into words at once.
    WORDS, LONGEST, CHARS = 1_500_000, 48, 4 << 20
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        parts = json.loads(self.tokenizer.to_str())
        added = parts["added_tokens"] or []
        self.by_words = (parts["normalizer"], parts["pre_tokenizer"]) == _BY_WORDS and not parts["truncation"] and not parts["padding"] and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in added)
        self.first_signs = {t["content"][0] for t in added}
        self.words = Words(self.tokenizer, self.width, self.WORDS, self.LONGEST)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of the encoder's width."""
        if not self.by_words:
            return [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out: list[list[bytes]] = [[] for _ in texts]
        owners, parts, size = [], [], 0
        for i, text in enumerate(texts):
            for part in self._stretches(text):
                owners.append(i)
                parts.append(part)
                size += len(part)
                if size >= self.CHARS:
                    self._add(out, owners, parts)
                    owners, parts, size = [], [], 0
        self._add(out, owners, parts)
        return [b"".join(x) for x in out]

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in parts of a bounded length, each ending at a blank, with newlines as blanks."""
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= self.CHARS else text.find(" ", at + self.CHARS)
            end = len(text) if end < 0 else end
            part = text[at:end].replace("\n", " ")
            if not any(s in part for s in self.first_signs):  # no added token begins here
                try:
                    part.encode("latin-1")  # no composition touches these characters, and each has one lower case, whatever stands around it
                    part = part.lower()
                except UnicodeEncodeError:
                    pass
            yield part
            at = end + 1

    def _add(self, out: list[list[bytes]], owners: list[int], parts: list[str]) -> None:
        """Add the ids of the parts to those of their texts; each word is looked up once."""
        if not parts:
            return
        cut = pc.split_pattern(pa.array(parts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        begin, sizes, flat = self.words.find(coded.dictionary)
        number = coded.indices.to_numpy()
        n = sizes[number]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[number] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stops = (ends[cut.offsets.to_numpy()] * np.dtype(self.width).itemsize).tolist()
        for i, a, b in zip(owners, stops, stops[1:], strict=False):
            out[i].append(ids[a:b])


_encoders: dict[str, TextEncoder] = {}


def encoder_at(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids: the ids of each whole text and the end id, as zstd-compressed little-endian integers."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = encoder_at(vocabulary)
        pack = zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], encoder.width).tobytes()
        for batch in batches:
            packed = [pack(x + end) for x in encoder.encode_many([x or "" for x in batch.column(1).to_pylist()])]
            yield pa.record_batch([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Write the files, in ascending doc_id order over all files, and return their blocks: part, path, offset, bytes, ids, start (in the part)."""
    encoder = encoder_at(vocabulary)
    size, width = max(encoder.tokenizer.get_vocab_size(), end_id + 1), encoder.width
    ids = materialize(token_ids(docs, vocabulary, end_id), "token-ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, total = zstandard.ZstdDecompressor().decompress, np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(unpack(x) for x in batch.column(0).to_pylist()), width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row for each id of the vocabulary at most
        counts[r.id] = r.n
    shared = FrequencyTable.from_counts(counts).to_bytes()
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/table.gmtb", compression=None) as out:
        out.write(shared)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        freqs, unpack = FrequencyTable.from_bytes(shared), zstandard.ZstdDecompressor().decompress
        store, root = open_store(folder)
        part, name = TaskContext.get().partitionId(), f"{root}/{commit_name()}.gmbk"
        rows, held, docs_in, n, offset, start, out = [], [], [], 0, 0, 0, None

        def flush():
            nonlocal held, docs_in, n, offset, start, out
            block = encode_block(np.frombuffer(b"".join(held), width).astype(np.int64), docs_in, freqs)
            out = out or store.open_output_stream(name, compression=None)
            out.write(block)
            rows.append((part, name.rpartition("/")[2], offset, len(block), n, start))
            offset, start = offset + len(block), start + n
            held, docs_in, n = [], [], 0

        for batch in batches:
            for key, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(unpack(packed))
                docs_in.append((key, len(held[-1]) // np.dtype(width).itemsize))
                n += docs_in[-1][1]
                if n >= BLOCK_IDS:
                    flush()
        if docs_in:
            flush()
        if out:
            out.close()
        if rows:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["part", "path", "offset", "bytes", "ids", "start"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    ordered = ids.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    blocks = materialize(ordered.mapInArrow(write, "part int, path string, offset long, bytes long, ids long, start long"), "token-blocks")
    discard(ids)
    return blocks


def read_token_files(blocks: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    spark = blocks.sparkSession
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n"))
    base = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        with store.open_input_file(f"{root}/table.gmtb") as f:
            freqs = FrequencyTable.from_bytes(f.read())
        for batch in batches:
            for path, offset, size, start in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                with store.open_input_file(f"{root}/{path}") as f:
                    f.seek(offset)
                    data = f.read(size)
                ids = decode_block(data, freqs).astype("<u4")
                _, docs = read_header(data)
                ends = np.cumsum(docs["n"].astype(np.int64))
                begin = ends - docs["n"].astype(np.int64)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin, ends, strict=True)]
                keys = pa.array([int(k) if h else None for k, h in zip(docs["id"], docs["has"], strict=True)], pa.int64())
                yield pa.record_batch([keys, pa.array(begin + start), pa.array(docs["n"].astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = blocks.join(base, "part").select("path", "offset", "bytes", (F.col("base") + F.col("start")).alias("start"))
    return placed.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs to a new folder in the shared one and read back doc_id, start, n_tokens, ids_crc32."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = fresh_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary, end_id), folder)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


assert sys.byteorder == "little"
