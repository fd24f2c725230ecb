"""Token-id output: each document one zstandard frame under a shared dictionary, with an offset index."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from talkloom.llm.common import partitions_for

#: The dictionary is trained on so many pieces (those of smallest hash) of so many bytes, cut from whole texts.
SAMPLE_PIECES, PIECE_BYTES = 2000, 4096
#: Texts whose pieces are drawn from are about so many; in smaller tables all of them.
SAMPLE_DOCS = 1000
DICTIONARY_BYTES = 64 << 10
#: A segment (one row of the file format) closes once its frames reach so many bytes.
SEGMENT_BYTES = 1 << 20
#: Words whose ids a task remembers before it starts anew; some 150 MB with their pieces.
WORDS_KEPT = 400_000
#: Of these the first ones, mostly frequent, stay for the worker's next task.
WORDS_STAY = 50_000

SEGMENT = (
    "shard int, segment int, dictionary_sha256 string, first_id long, last_id long, start long, n_tokens long, "
    "doc_ids array<long>, counts array<int>, offsets array<long>, payload binary"
)
BETWEEN_WORDS = re.compile(r"[ \n\t\r]+")
#: Words of these characters are their own NFC form, and lower() maps them one by one to the second set.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
MARKS = frozenset(".,;:!?)")
PLAIN_TEXT = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ſ]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: its own character where that is visible, the next free one from 256 on elsewhere."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()
_encoders: dict = {}


class Encoder(dict):
    """Ids of whole texts, equal to the library's own; a mapping from words to their ids that fills itself.

    The vocabulary's normaliser and splitter never look across white space, so a text's ids are its words'
    ids in turn.  Plain words are cut into pieces here and go to the library's model; any other word goes
    through the library's whole path.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.width = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.width.itemsize == 2 else "I"
        self.pieces: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.width).tobytes()

    def piece(self, text: str) -> bytes:
        known = self.pieces.get(text)
        if known is None:
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
            known = self.pieces[text] = self.packed([t.id for t in self.model.tokenize(letters)])
        return known

    # a word is never empty but where a text begins or ends with white space
    def __missing__(self, word: str) -> bytes:
        if not word:
            ids = b""
        elif word.isascii() and word.isalpha():
            ids = self.piece(word.lower())
        elif word[-1] in MARKS and word[:-1].isascii() and word[:-1].isalpha():
            ids = self.piece(word[:-1].lower()) + self.piece(word[-1])
        elif PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.piece, PIECE.findall(word.lower())))
        else:
            ids = self.packed(self.whole.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        if PLAIN_TEXT.fullmatch(text) and "<|" not in text:
            words = text.lower().split()
        else:
            words = BETWEEN_WORDS.split(text)
        ids = b"".join(map(self.__getitem__, words))
        if len(self) > WORDS_KEPT:
            self.forget()
        return ids

    def forget(self) -> None:
        stay = dict(islice(self.items(), WORDS_STAY)), dict(islice(self.pieces.items(), WORDS_STAY))
        self.clear()
        self.update(stay[0])
        self.pieces = stay[1]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A zstandard dictionary from serialized ids; empty only where no text is.

    Pieces of whole texts are the sample: those of the smallest hashes among the pieces of about SAMPLE_DOCS
    texts, so SAMPLE_PIECES * PIECE_BYTES bounds what reaches the driver.  Where there is too little to
    train on, the sampled ids themselves are the dictionary.
    """
    import zstandard

    rows = docs.count()
    share = F.lit(1.0) if rows <= SAMPLE_DOCS else F.lit(SAMPLE_DOCS / rows)
    mark = F.xxhash64("doc_id", F.octet_length("text"))
    some = docs.where((F.shiftrightunsigned(mark, 11) / F.lit(float(1 << 53)) < share) & (F.col("text") != "")).select(mark.alias("h"), "text")

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        for batch in batches:
            marks, pieces = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = codes.text(text.as_py())
                cut = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
                marks += [xxhash.xxh64_intdigest(p, h & (1 << 63) - 1) >> 1 for p in cut]
                pieces += cut
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(pieces, pa.binary())], names=["h", "piece"])
        codes.forget()

    best = some.mapInArrow(serialize, "h long, piece binary").orderBy("h", "piece").limit(SAMPLE_PIECES)
    samples = [bytes(r["piece"]) for r in best.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents in ascending order of identifier and write them under `path`.

    dictionary/  one row: the dictionary, its SHA-256, bytes of an id, the end id
    segments/    rows of about a megabyte: frames one after another, with identifiers, counts and offsets
    shards/      one row per output partition: its documents, ids, and the number of ids before it

    Null texts are empty and hold the end id only; null identifiers come first; rows that repeat an
    identifier all stay, in order of their texts' hashes, so that they can lie in several partitions.  A text
    of any length is one frame, held whole by one task.  Empty tables write an empty dictionary and no
    segment.  Other columns are ignored.
    """
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    trained = train_dictionary(rows, tokenizer)
    digest, size = hashlib.sha256(trained).hexdigest(), encoder(tokenizer).width.itemsize
    head = [(digest, bytearray(trained), size, end_id)]
    spark.createDataFrame(head, "sha256 string, dictionary binary, id_bytes int, end_id int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)
    arrow = pa.schema(
        [("shard", pa.int32()), ("segment", pa.int32()), ("dictionary_sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
         ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("payload", pa.binary())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(tokenizer)
        frame = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_content_size=True)
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        end = codes.packed([end_id])
        ids: list = []
        counts: list[int] = []
        offsets, frames = [0], []

        def close() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = (shard, segment, digest, min(known, default=None), max(known, default=None), start, sum(counts), ids, counts, offsets, b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = codes.text(text.as_py()) + end
                packed = frame.compress(raw)
                ids.append(doc_id)
                counts.append(len(raw) // codes.width.itemsize)
                frames.append(packed)
                offsets.append(offsets[-1] + len(packed))
                if offsets[-1] >= SEGMENT_BYTES:
                    yield close()
                    segment, start = segment + 1, start + sum(counts)
                    ids, counts, offsets, frames = [], [], [0], []
        if ids:
            yield close()
        codes.forget()

    place = ["doc_id", "mark"]
    ordered = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(partitions_for(docs), *place).sortWithinPartitions(*place, "text")
    ordered.select("doc_id", "text").mapInArrow(encode, SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    shards = segments.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per partition of the output
    shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).coalesce(1).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, *, ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) back from the files; `ids` opens only the frames of those documents.

    A segment whose dictionary hash differs from the stored dictionary's raises an error.
    """
    import zstandard

    head = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(head["dictionary"]).hexdigest() != head["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    trained = spark.sparkContext.broadcast(bytes(head["dictionary"]))
    digest, width = head["sha256"], np.dtype(f"<u{head['id_bytes']}")
    wanted = None if ids is None else set(ids)
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    if ids is not None:
        span = F.lit(False)
        for i in ids:
            span = span | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        segments = segments.where(span)
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("start").alias("shard_start"))
    placed = segments.join(F.broadcast(shards), "shard")  # one row per partition of the output
    placed = placed.select((F.col("shard_start") + F.col("start")).alias("start"), "dictionary_sha256", "doc_ids", "counts", "offsets", "payload")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    arrow = pa.schema([*kinds, ("ids", pa.list_(pa.int32()))] if with_ids else kinds)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained.value) if trained.value else None)
        for batch in batches:
            for k in range(batch.num_rows):
                start, sha, doc_ids, counts, offsets = (batch.column(c)[k].as_py() for c in range(5))
                if sha != digest:
                    raise ValueError("a segment was written with another dictionary")
                payload = memoryview(batch.column(5)[k].as_buffer())
                out: list[tuple] = []
                for i, doc_id in enumerate(doc_ids):
                    if wanted is None or doc_id in wanted:
                        got = np.frombuffer(frame.decompress(payload[offsets[i] : offsets[i + 1]]), width).astype("<u4")
                        out.append((doc_id, start, counts[i], zlib.crc32(got.tobytes()), *([got.astype("<i4")] if with_ids else [])))
                    start += counts[i]
                columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
