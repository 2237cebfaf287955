"""Token ids in fixed-width bit-packed files.

Image layout (little-endian): the magic ``TIDB``, u16 version, u16 bits, u64 documents, u64 ids;
then i64 doc ids, u8 null flags of doc ids, u64 first id of each document plus the end, u64 byte
offset of each block plus the end; then the blocks. A block holds ``BLOCK`` ids (the last is padded
with zeros) as groups of 64 ids in ``bits`` 64-bit words, so that a lane of all groups unpacks in one
numpy operation and any id is found from its number alone. Images travel as rows of a Spark-written
table: the commit protocol, retries and any store that Spark reaches come with it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from functools import cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, ship

MAGIC, VERSION = b"TIDB", 1
LANES, BLOCK = 64, 4096
#: Ids that are packed in one go (whole blocks; more leave the processor's cache).
SLICE = 16 * BLOCK
#: An image is closed at the first document that brings it to this many ids.
IMAGE_IDS = 1 << 20
END_ID = 0
#: Pieces of text whose ids a memory of a Python worker holds, and the characters of the longest.
REMEMBERED, LONGEST = 1 << 19, 256
#: The characters that the pre-tokenizer's \s matches (Unicode White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that a run of letters is parted from (an apostrophe may begin a contraction).
MARKS = ".,;:!?#$%&*"


def byte_chars() -> dict[int, int]:
    """Byte -> code point in the alphabet of byte-level models: printable ones stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(rest)}


BYTE_CHARS = byte_chars()
PIECE, ADJACENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+"), re.compile(f"[{SPACES}]{{2}}")
#: Of ASCII: pairs of the common spaces, and the rare spaces.
PAIRS, RARE = ("  ", " \n", "\n ", "\n\n"), "\t\x0b\x0c\r"


def has_adjacent(text: str) -> bool:
    """Whether two white-space characters adjoin; plain searches answer for most texts."""
    if not text.isascii() or any(c in text for c in RARE):
        return ADJACENT.search(text) is not None
    return any(pair in text for pair in PAIRS)


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` as groups of 64 in ``bits`` words of 64 bits, zero-padded to whole groups."""
    groups = -(-len(ids) // LANES)
    lanes = np.zeros((groups, LANES), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for lane in range(LANES):
        word, at = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(at)
        if at + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - at)
    return out.astype("<u8").tobytes()


def unpack(packed, bits: int) -> np.ndarray:
    """All ids of whole groups, padding included."""
    data = np.frombuffer(packed, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(data), LANES), np.uint32), np.uint64((1 << bits) - 1)
    for lane in range(LANES):
        word, at = divmod(lane * bits, 64)
        x = data[:, word] >> np.uint64(at)
        if at + bits > 64:
            x = x | (data[:, word + 1] << np.uint64(64 - at))
        out[:, lane] = x & mask
    return out.reshape(-1)


def write_image(doc_ids: list, starts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One image of documents; ``starts`` holds each document's first id and, last, the end."""
    packed = [pack(ids[i : i + SLICE], bits) for i in range(0, len(ids), SLICE)]
    whole = BLOCK // LANES * bits * 8  # bytes of a full block
    offsets = np.minimum(np.arange(-(-len(ids) // BLOCK) + 1) * whole, sum(map(len, packed)))
    return b"".join(
        [
            MAGIC, np.array([VERSION, bits], "<u2").tobytes(), np.array([len(doc_ids), len(ids)], "<u8").tobytes(),
            np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
            np.array([x is None for x in doc_ids], np.uint8).tobytes(),
            np.asarray(starts, "<u8").tobytes(), offsets.astype("<u8").tobytes(), *packed,
        ]
    )


class Image:
    """Random access to an image in memory (or a memory map of an exported file)."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:4]) != MAGIC:
            raise ValueError("not a token-id image")
        version, self.bits = np.frombuffer(self.data, "<u2", 2, 4).tolist()
        if version != VERSION:
            raise ValueError(f"image version {version}")
        self.n_docs, self.n_ids = np.frombuffer(self.data, "<u8", 2, 8).tolist()
        at = 24
        ids = np.frombuffer(self.data, "<i8", self.n_docs, at)
        null = np.frombuffer(self.data, np.uint8, self.n_docs, at + 8 * self.n_docs)
        self.doc_ids = [None if n else x for x, n in zip(ids.tolist(), null.tolist(), strict=True)]
        at += 9 * self.n_docs
        self.starts = np.frombuffer(self.data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        blocks = -(-self.n_ids // BLOCK)
        self.offsets = np.frombuffer(self.data, "<u8", blocks + 1, at).astype(np.int64)
        self.body = at + 8 * (blocks + 1)

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``end`` (exclusive); only their blocks are read."""
        end = self.n_ids if end is None else end
        if first >= end:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, -(-end // BLOCK)
        part = self.data[self.body + self.offsets[a] : self.body + self.offsets[b]]
        return unpack(part, self.bits)[first - a * BLOCK : end - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Memory(dict):
    """Ids by piece of text, in bounded space whatever the texts."""

    def put(self, piece: str, ids: bytes) -> None:
        if len(piece) > LONGEST:
            return
        if len(self) >= REMEMBERED:  # the pieces met first are mostly the frequent ones
            kept = list(islice(self.items(), REMEMBERED // 2))
            self.clear()
            self.update(kept)
        self[piece] = ids


class Encoder:
    """A tokenizer of the tokenizers library that remembers the ids of pieces of text.

    With a byte-level pre-tokenizer no token spans a step from a character to white space, so a text
    may be cut there and each piece encoded by itself. Any other tokenizer encodes whole texts, and so
    is a text encoded that holds the string of an added token (a special one, say): the library looks
    for those before it pre-tokenizes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in said.get("added_tokens") or () if t["content"]]
        pre = said.get("pre_tokenizer") or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and not any(said.get(k) for k in ("normalizer", "truncation", "padding"))
        self.cuts = byte_level and said["model"]["type"] == "BPE" and not said["model"].get("dropout")
        self.bits = id_bits(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.kind = np.dtype(np.uint16 if self.bits <= 16 else np.uint32)
        self.spaced = Memory()  # with a space before the piece unless it begins with a line feed
        self.bare, self.marks = Memory(), Memory()
        self.model = self.tokenizer.model

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, piece: str, space: str) -> bytes:
        """Ids of one piece. Letters, with marks of punctuation after them, go straight to the model."""
        letters = piece.rstrip(MARKS)
        if not letters.isalpha():
            return self._whole(piece if piece[:1] == "\n" else space + piece)
        if len(letters) < len(piece):
            known = self.spaced if space else self.bare
            ids = known.get(letters)
            if ids is None:
                ids = self._word(letters, space)
            marks = piece[len(letters) :]
            after = self.marks.get(marks)
            if after is None:
                self.marks.put(marks, after := self._whole(marks))
            return ids + after
        seen = (space + letters).encode().decode("latin-1").translate(BYTE_CHARS)
        return array(self.kind.char, [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _ids(self, known: Memory, pieces: list[str], space: str) -> bytes:
        ids = list(map(known.get, pieces))
        if None in ids:
            for k in [k for k, x in enumerate(ids) if x is None]:
                piece = pieces[k]
                found = known.get(piece)
                if found is None:
                    known.put(piece, found := self._word(piece, space))
                ids[k] = found
        return b"".join(ids)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.cuts or any(token in text for token in self.added):
            return np.frombuffer(self._whole(text), self.kind)
        if has_adjacent(text):
            return np.frombuffer(self._ids(self.bare, PIECE.findall(text), ""), self.kind)
        first, *rest = text.replace("\n", " \n").split(" ")
        ids = self._ids(self.spaced, rest, " ")
        return np.frombuffer(self._ids(self.bare, [first], "") + ids if first else ids, self.kind)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the images, in ascending doc_id order, as a table at ``path``.

    Rows (part, seq, n_docs, n_ids, image): ``part`` is the range of doc_ids, ``seq`` the image's
    place in it. ``end_id`` follows each document. Null texts are empty; null ids come first; rows
    with one doc_id are ordered by their text's hash. Other columns are not read. ``tokenizer`` is
    a file that every executor can open.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    d = d.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = "part int, seq int, n_docs long, n_ids long, image binary"

    def images(batches):
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.kind)
        seq, part, names, arrays, n = 0, 0, [], [], 0

        def image():
            starts = np.cumsum([0, *map(len, arrays)])
            row = [part, seq, len(names), n, write_image(names, starts, np.concatenate(arrays), coder.bits)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "seq", "n_docs", "n_ids", "image"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                for part, name, body in zip(rows["part"], rows["doc_id"], rows["text"], strict=True):  # noqa: B007
                    names.append(name)
                    arrays.append(np.concatenate([coder.encode(body), end]))
                    n += len(arrays[-1])
                    if n >= IMAGE_IDS:
                        yield image()
                        seq, names, arrays, n = seq + 1, [], [], 0
        if names:
            yield image()

    d.mapInArrow(images, kind).write.mode("overwrite").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32, part, seq, nth.

    A null doc_id comes back null; repeated rows come back each time; files without images (an empty
    table) give no rows. ``start`` counts the ids of all documents before, in the files' order.
    """
    import pyarrow as pa

    ship(spark)
    files = spark.read.parquet(path)
    names = ["part", "seq", "nth", "doc_id", "_at", "n_tokens", "ids_crc32"]
    kind = "part int, seq int, nth int, doc_id long, _at long, n_tokens long, ids_crc32 long"

    def decode(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "image")), strict=True):
                image = Image(data.as_buffer())
                ids = image.ids().astype("<u4")
                at = image.starts.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:], strict=False)]
                n = image.n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()),
                        pa.array(image.doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(image.starts), pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names,
                )

    d = files.select("part", "seq", "image").mapInArrow(decode, kind)
    sizes = files.select("part", "seq", "n_ids")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    offsets = sizes.withColumn("_seq", before).join(parts, "part").select("part", "seq", (F.col("_part") + F.col("_seq")).alias("_offset"))
    return d.join(offsets, ["part", "seq"]).select("doc_id", (F.col("_offset") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", "part", "seq", "nth")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the files under the shared checkpoint folder and describe the documents read back.

    Nulls, empty texts, repeats, an empty table and other columns are as for ``write_token_files``
    and ``read_documents``: a row per row of ``docs``.
    """
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, **options)
    return read_documents(spark, path)
