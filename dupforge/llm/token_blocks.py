"""Operator 1, BPE encoding and decoding with a distinct-word table.

1. Documents are gathered into blocks of consecutive rows (a few MB of text). Each block is split into words once, and its
   distinct words are dealt to buckets by a hash of the word.
2. A bucket sees a word once for each block that has it. It encodes each distinct word once with the tokenizer's own model, and
   sends the ids back to each block that asked.
3. A block meets its documents again: the ids of a document's words are joined by position. Decoding looks each id up in the
   id-to-piece table, whose size is that of the vocabulary, and joins the pieces.

Words and ids travel packed, a row for each block and bucket, so a word that all documents have costs a row's share a block.
A block's documents travel compressed. If a retried task cuts its blocks in another way (its input read in another order), a
word may be missing from a block's table; it is then encoded in place, with the same result.

Equal to the tokenizers library's encode(text, add_special_tokens=False) without truncation or padding, followed by
decode(ids, skip_special_tokens=False): the library's own normalizer prepares every text that isn't plain ASCII, its own
pre-tokenizer splits every text with a character beyond Latin letters and common punctuation, and texts that contain one of the
tokenizer's added tokens are encoded whole.

Defined results: null text counts as empty (no ids, an empty decoded text); rows that repeat give rows that repeat; a null doc_id
stays null; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupforge.llm.common import documents, tokenizer_file

TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20

#: Fixed value: the word pattern of word_bpe_49k.json.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBPE:
    """The parts of a word-level tokenizer: text to words, word to ids, ids to text."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = tokenizer_file(name)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        said = json.load(open(path, encoding="utf-8"))
        steps = said["pre_tokenizer"]["pretokenizers"]
        if [x.get("pattern", {}).get("Regex") for x in steps] != [SPLIT, None] or said["decoder"]:
            raise ValueError(f"{name} splits words or decodes in a way that this operator doesn't know")
        self.added = re.compile("|".join(re.escape(x["content"]) for x in said["added_tokens"]) or r"(?!)")
        self.split = regex.compile(SPLIT)
        #: Characters whose class no Unicode version disputes; the library's own tables are of another version than those of the regex module.
        self.safe = re.compile(r"[\x00-\u024F\u2010-\u2027]*").fullmatch
        self.own_split = Tokenizer.from_str(json.dumps(said | {"pre_tokenizer": steps[0]})).pre_tokenizer.pre_tokenize_str
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x200-9a-z]+")
        self.by_word = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "pre_tokenizer": steps[1]}))
        self.pieces = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]

    def words(self, text: str) -> list[str] | None:
        """None: the text has an added token and is to be encoded whole."""
        if "<" in text and self.added.search(text):
            return None
        if text.isascii():
            return self.plain.findall(text.lower())
        text = self.tok.normalizer.normalize_str(text)
        return self.split.findall(text) if self.safe(text) else [w for w, _ in self.own_split(text)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Of words that words() gave: they are normalised and split already."""
        return [np.array(e.ids, dtype="<u4") for e in self.by_word.encode_batch_fast(words, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library does it where a tokenizer names no decoder: pieces joined by spaces."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def model(name: str) -> WordBPE:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    return WordBPE(name)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows with about block_bytes of text. A block's number holds its partition, and so is its own."""
    number, held, n = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        for end in (np.flatnonzero(np.diff((n + np.cumsum(sizes)) // block_bytes)) + 1).tolist() + [len(sizes)]:
            held.append(batch.slice(start, end - start))
            n += int(sizes[start:end].sum())
            start = end
            if n >= block_bytes:
                yield number, pa.Table.from_batches(held)
                number, held, n = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _packed(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


DOCS = pa.schema([("block", pa.int64()), ("docs", pa.binary())])
WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())])
IDS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())])


def _pack_documents(batches, block_bytes):
    for block, table in _blocks(batches, block_bytes):
        yield _batch(DOCS, block=[block], docs=[_packed(table)])


def _pack_words(batches, tokenizer, block_bytes, n_buckets):
    bpe = model(tokenizer)
    for block, table in _blocks(batches, block_bytes):
        distinct: set[str] = set()
        for text in table.column("text"):
            distinct.update(bpe.words(text.as_py() or "") or ())
        dealt: dict[int, list[str]] = {}
        for word in distinct:
            dealt.setdefault(zlib.crc32(word.encode()) % n_buckets, []).append(word)
        for bucket, words in dealt.items():
            yield _batch(WORDS, block=[block], bucket=[bucket], words=[_packed(pa.table({"w": sorted(words)}))])


def _encode_bucket(table: pa.Table, tokenizer: str) -> pa.Table:
    """One bucket: rows of (block, words). Each distinct word is encoded once."""
    bpe = model(tokenizer)
    cells = [_unpacked(x.as_py()).column("w") for x in table.column("words")]
    distinct = pc.unique(pa.chunked_array([c for x in cells for c in x.chunks], pa.string()))
    ids = bpe.encode_words(distinct.to_pylist())
    rows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate([*ids, np.array([], "<u4")]), pa.uint32()))
    out = [_packed(pa.table({"i": rows.take(pc.index_in(x.combine_chunks(), distinct))})) for x in cells]
    return pa.table([table.column("block"), table.column("words"), pa.array(out, pa.binary())], schema=IDS)


def _join_block(left: pa.Table, right: pa.Table, tokenizer: str, schema: pa.Schema) -> pa.Table:
    """Documents of a block, and the ids of its words: joined by position."""
    bpe, ids_of = model(tokenizer), {}
    for words, ids in zip(right.column("words"), right.column("ids"), strict=True):
        rows = _unpacked(ids.as_py()).column("i").combine_chunks()
        flat, at = rows.values.to_numpy().astype("<u4").tobytes(), (rows.offsets.to_numpy() * 4).tolist()
        ids_of.update(zip(_unpacked(words.as_py()).column("w").to_pylist(), map(flat.__getitem__, map(slice, at, at[1:])), strict=True))
    out: dict[str, list] = {f.name: [] for f in schema}
    for docs in left.column("docs"):
        table = _unpacked(docs.as_py())
        for doc_id, text in zip(table.column("doc_id"), table.column("text"), strict=True):
            text = text.as_py() or ""
            words = bpe.words(text)
            if words is None:
                ids = bpe.encode(text)
            else:
                try:
                    ids = np.frombuffer(b"".join(map(ids_of.__getitem__, words)), "<u4")
                except KeyError:
                    ids = np.concatenate([*bpe.encode_words(words), np.array([], "<u4")])
            decoded = bpe.decode(ids)
            made = {"doc_id": doc_id.as_py(), "n_tokens": len(ids), "ids": ids, "decoded": decoded}
            if "ids_sha256" in out:
                made |= {"ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
            for k, v in out.items():
                v.append(made[k])
    return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)


def _round_trip(docs: DataFrame, schema: pa.Schema, spark_schema: str, tokenizer: str, block_bytes: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = max(8, -(-total // BUCKET_BYTES))
    packed = docs.mapInArrow(lambda b: _pack_documents(b, block_bytes), "block long, docs binary")
    words = docs.mapInArrow(lambda b: _pack_words(b, tokenizer, block_bytes, n_buckets), "block long, bucket int, words binary")
    ids = words.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, tokenizer), "block long, words binary, ids binary")
    return packed.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(lambda left, right: _join_block(left, right, tokenizer, schema), spark_schema)


def encode_decode(docs: DataFrame, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids, decoded for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])
    return _round_trip(docs, schema, "doc_id long, n_tokens long, ids array<long>, decoded string", tokenizer, block_bytes)


def encode_decode_digests(docs: DataFrame, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same with digests of the ids and of the decoded text in their place, taken where they are made."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _round_trip(docs, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", tokenizer, block_bytes)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(documents(spark, sf_dir))
