"""Token-ID / binary output (operator 7): framed records with an offset index.

File format. A data file is a sequence of records
``u64 length | u32 masked crc(length bytes) | payload | u32 masked crc(payload)``,
little-endian, where a payload is ``u8 has_id | i64 doc_id | u8 width | ids`` with
ids of ``width`` (2 or 4) bytes and masked crc = rotate right by 15 of the CRC-32,
plus 0xA282EAD8. Beside it an index file has ``i64 doc_id | u64 offset | u64 tokens``
a record, so single records can be read in any order.

Documents are range-partitioned and sorted by doc_id, so part k's records come
before part k+1's. A task writes to a name of its own attempt and returns it; only
names returned by successful tasks reach the manifest, so a retried or speculative
task leaves at most a file nobody reads. Files go to the shared folder through
Arrow's file systems.

Encoding: the tokenizer drops white space, so a text's ids are its words' ids in
order. Each slice's distinct words are encoded once and the ids gathered; a bounded
per-worker cache keeps words that come again.

Defined results: a null or empty text is the end id alone; null ids sort first;
repeated rows give repeated records.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import col, prepare, scratch_dir, slices, stored, table, texts

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 160_000
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<?qB")
_INDEX = struct.Struct("<qQQ")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = _META.pack(doc_id is not None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    size = len(payload).to_bytes(8, "little")
    return size + masked_crc(size).to_bytes(4, "little") + payload + masked_crc(payload).to_bytes(4, "little")


def index_entry(doc_id: int | None, offset: int, n_tokens: int) -> bytes:
    return _INDEX.pack(doc_id or 0, offset, n_tokens)


def read_record(stream) -> tuple[int | None, np.ndarray] | None:
    """The next record's (doc_id, ids); None at the end; ValueError if damaged."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("record header is cut off")
    size, crc = _HEAD.unpack(head)
    if masked_crc(head[:8]) != crc:
        raise ValueError("record length is damaged")
    body = stream.read(size + 4)
    if len(body) < size + 4 or masked_crc(body[:size]) != int.from_bytes(body[size:], "little"):
        raise ValueError("record payload is damaged")
    has_id, doc_id, width = _META.unpack_from(body)
    ids = np.frombuffer(body, f"<u{width}", (size - _META.size) // width, _META.size)
    return (doc_id if has_id else None), ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: For each vocabulary the words of two generations: a full young one becomes the old
#: one, and words that come again move to the young one.
_CACHES: dict[str, list[dict[bytes, bytes]]] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the
    other bytes for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(visible)))}


_LETTERS = _byte_letters()


def _simple(word: str) -> str | None:
    """The model's input for a word of letters that normalisation leaves alone (one
    pre-token); None for any other word."""
    if word.isalpha():
        if word == word.lower() and unicodedata.is_normalized("NFC", word):
            return word.encode().decode("latin-1").translate(_LETTERS)
    return None


#: The pre-tokens of a word of visible ASCII characters without capitals.
_ASCII = re.compile(rb"[!-;=-@\[-~]+")
_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def _pieces(word: bytes) -> list[bytes] | None:
    """The pre-tokens of such a word; None for any other, and for one with the sign
    that special tokens begin with."""
    return _PIECES.findall(word) if _ASCII.fullmatch(word) else None


def word_ids(words: list[bytes], path: str) -> list[bytes]:
    """Ids (little-endian u32) of distinct words, through the worker's cache. Simple
    words, and simple words before a full stop or comma (a pre-token of its own), go
    straight to the tokenizer's model, as do the pre-tokens of other ASCII words; the
    rest through its whole chain."""
    tok = _tokenizer(path)
    tokenize = tok.model.tokenize
    generations = _CACHES.setdefault(path, [{}, {}])
    if len(generations[0]) > CACHE_WORDS:
        generations[:] = [{}, generations[0]]
    cache, old = generations
    found = list(map(cache.get, words))
    for i in [i for i, known in enumerate(found) if known is None]:
        ids = old.get(words[i])
        if ids is not None:
            found[i] = cache[words[i]] = ids
    odd, ends = [], {c: array("I", tok.encode(c.decode(), add_special_tokens=False).ids).tobytes() for c in (b".", b",")}
    for i in [i for i, known in enumerate(found) if known is None]:
        w = words[i]
        mark = ends.get(w[-1:], b"")
        stem = w[:-1] if mark else w
        # bytes.isalpha() holds for ASCII letters only, and those are lower case here
        piece = stem.decode() if stem.isalpha() and stem.islower() else _simple(stem.decode("utf-8", "replace"))
        if piece is None:
            pieces = _pieces(w)
            if pieces is None:
                odd.append(i)
                continue
            ids = b""
            for name in pieces:
                part = cache.get(name)
                if part is None:
                    part = cache[name] = array("I", [t.id for t in tokenize(name.decode())]).tobytes()
                ids += part
            found[i] = cache[w] = ids
            continue
        ids = cache.get(stem) if mark else None
        if ids is None:
            ids = cache[stem] = array("I", [t.id for t in tokenize(piece)]).tobytes()
        found[i] = ids
        if mark:
            found[i] = cache[w] = ids + mark
    rest = tok.encode_batch_fast([words[i].decode("utf-8", "replace") for i in odd], add_special_tokens=False) if odd else []
    for i, e in zip(odd, rest):
        found[i] = cache[words[i]] = array("I", e.ids).tobytes()
    return found


def encode(raw: list[bytes], path: str) -> list[np.ndarray]:
    """The ids of each whole text, with the end id."""
    # the vocabulary is lower case; texts that may hold a special token's name keep theirs
    lists = [(t if b"<|" in t else t.lower()).split() for t in raw]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for ws in lists for w in ws]
    which, uniques = pd.factorize(flat)
    coded = word_ids(list(uniques), path)
    lens = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    pool = np.frombuffer(b"".join(coded), "<u4")
    first = np.concatenate(([0], np.cumsum(lens)))
    n = lens[which] if len(which) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    ids = pool[np.repeat(first[which] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
    cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
    return [np.append(ids[a:b], np.uint32(END_ID)) for a, b in zip(cuts, cuts[1:])]


def file_system(uri: str):
    """(Arrow file system, path in it) of a folder's URI or absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def write_records(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) in ascending doc_id order. Returns the
    manifest, one row a file: seq, path, n_records, n_tokens, start (tokens before)."""
    spark = docs.sparkSession
    prepare(spark)
    vocab = vocabulary or default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = pa.schema([("seq", pa.int64()), ("path", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        data = index = None
        records = tokens = offset = 0
        width = 2 if _tokenizer(vocab).get_vocab_size() <= 1 << 16 else 4
        seq = TaskContext.get().partitionId()
        name = f"part-{seq:07d}-{uuid.uuid4().hex}"
        for b in slices(batches):
            if data is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                data = fs.open_output_stream(f"{base}/{name}.bin")
                index = fs.open_output_stream(f"{base}/{name}.idx")
            for doc_id, ids in zip(col(b, "doc_id").to_pylist(), encode(texts(b), vocab)):
                record = frame(doc_id, ids, width)
                data.write(record)
                index.write(index_entry(doc_id, offset, len(ids)))
                offset += len(record)
                records += 1
                tokens += len(ids)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"seq": [seq], "path": [f"{folder}/{name}"], "n_records": [records], "n_tokens": [tokens]}, schema=schema)

    manifest = stored(rows.mapInArrow(run, "seq long, path string, n_records long, n_tokens long"), "records-manifest")
    ahead = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's files, checksums verified, in file order:
    doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for path, start in zip(col(b, "path").to_pylist(), col(b, "start").to_pylist()):
                fs, base = file_system(path)
                out = []
                with fs.open_input_stream(f"{base}.bin", buffer_size=1 << 20) as stream:
                    while (record := read_record(stream)) is not None:
                        doc_id, ids = record
                        out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], schema=schema)

    spread = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(path: str, position: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: the shuffled read."""
    fs, base = file_system(path)
    with fs.open_input_file(f"{base}.idx") as index:
        index.seek(position * _INDEX.size)
        _, offset, _ = _INDEX.unpack(index.read(_INDEX.size))
    with fs.open_input_file(f"{base}.bin") as data:
        data.seek(offset)
        return read_record(data)


def token_files(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    folder = f"{scratch_dir(docs.sparkSession)}/records-{uuid.uuid4().hex}"
    return read_records(write_records(docs, folder, vocabulary))


def op7(spark, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))
