"""Byte-level BPE encoding and decoding of whole texts with a given public vocabulary."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textpack

#: How many pieces of text a Python worker keeps the ids of, and up to which length: some 50 MB at most.
CACHED_PIECES, CACHED_LENGTH = 200_000, 24
#: Splits text before any merge; white space is Unicode's White_Space property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    out, spare = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(spare)] = b
            spare += 1
    return out


def load_vocabulary(path: str) -> dict:
    """Bytes by id, merges in order of rank as id triples, and the special strings of a tokenizer file.

    Raises ValueError for a file that splits, normalises or merges in another way than is built here.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", False)
    if not plain or spec.get("normalizer") or model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    tokens = [b""] * size
    for text, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in text)
    for text, i in special.items():
        tokens[i] = text.encode()
    merges = []
    for pair in spec["model"]["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[left], vocab[right], vocab[left + right]))
    first = [0] * 256
    for c, b in letters.items():
        first[b] = vocab[c]
    return {"tokens": tokens, "merges": merges, "first": first, "special": special}


class Encoder(dict):
    """Packed ids (little-endian, 32 bits) by piece of text; a missing piece is merged and kept."""

    def __init__(self, vocabulary: dict, cached: int = CACHED_PIECES):
        super().__init__()
        self.first, self.special, self.cached = vocabulary["first"], vocabulary["special"], cached
        self.ranks = {a << 32 | b: (rank, c) for rank, (a, b, c) in enumerate(vocabulary["merges"])}
        self.pieces = regex.compile(PIECES)
        found = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.merged(piece.encode())).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.cached:
                self.clear()
            self[piece] = out
        return out

    def merged(self, data: bytes) -> list[int]:
        """Always the merge of least rank next, the leftmost of equals: a heap over a doubly linked list of symbols.

        An entry names the two symbols it was made for; if either has been
        merged since, the entry is stale and is skipped.
        """
        symbols = [self.first[b] for b in data]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if found := ranks.get(symbols[i] << 32 | symbols[i + 1]):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get(new << 32 | symbols[k]):
                    heapq.heappush(heap, (found[0], i, new, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get(symbols[h] << 32 | new)):
                heapq.heappush(heap, (found[0], h, symbols[h], new, found[1]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.pieces.findall(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            else:
                out.extend(map(self.__getitem__, self.pieces.findall(part)))
        return b"".join(out)


_ready: dict = {}


def _once(kind: str, broadcast, make):
    """One object of a kind in a Python worker, made from the broadcast vocabulary; that of an earlier broadcast is dropped first."""
    key = broadcast.id if hasattr(broadcast, "id") else id(broadcast)
    if _ready.get(kind, (None, None))[0] != key:
        _ready.pop(kind, None)
        _ready[kind] = key, make(broadcast.value)
    return _ready[kind][1]


def _mapped(df: DataFrame, source: str, targets: dict[str, T.DataType], work) -> DataFrame:
    """df with the columns `targets` made from `source` in one pass, slice by slice: work() gives a function from a column to a list of columns."""
    df = df.drop(*targets)
    common.small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in targets.items())])
    arrow = [pa.string() if isinstance(kind, T.StringType) else pa.binary() for kind in targets.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = work()
        for batch in batches:
            for part, _, _ in textpack.slices(batch, source):
                out = [pa.array(column, kind) for column, kind in zip(call(part.column(source)), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *targets])

    return df.mapInArrow(run, schema)


def _encoder(shared):
    encoder = _once("encode", shared, Encoder)
    return lambda column: [encoder.encode(x.as_py() or "") for x in column]


def _decoder(shared):
    tokens = _once("decode", shared, lambda v: v["tokens"])
    return lambda packed: [b"".join(map(tokens.__getitem__, array("I", x or b""))).decode("utf-8", "replace") for x in packed]


def encode(df: DataFrame, vocabulary: dict, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with binary column `ids`: each whole text's token ids, little-endian unsigned 32 bits each.

    Special strings of the vocabulary become their own ids, as the tokenizers
    library does. Null and empty texts give empty ids; rows, repeats and
    columns stay as they are, an existing `ids` column is replaced. Long texts
    take n log n time. The vocabulary, some 50,000 entries, is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        call = _encoder(shared)
        return lambda column: [call(column)]

    return _mapped(df, text, {ids: T.BinaryType()}, work)


def decode(df: DataFrame, vocabulary: dict, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with string column `text`: the vocabulary's strings of all ids, concatenated; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        call = _decoder(shared)
        return lambda column: [call(x.as_py() for x in column)]

    return _mapped(df, ids, {text: T.StringType()}, work)


def encode_and_decode(df: DataFrame, vocabulary: dict, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What decode(encode(df)) gives, in one pass: a task then needs one Python worker in place of two."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def work():
        there, back = _encoder(shared), _decoder(shared)

        def call(column):
            packed = there(column)
            return [packed, back(packed)]

        return call

    return _mapped(df, text, {ids: T.BinaryType(), decoded: T.StringType()}, work)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, null and empty texts with 0 tokens; repeated rows and ids stay, other columns are not read, an empty table gives no rows."""
    vocabulary = load_vocabulary(path or vocabulary_path())
    coded = encode_and_decode(df.select("doc_id", "text"), vocabulary)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of all documents as checksums; as digests() says."""
    return digests(common.documents(spark, sf_dir), path)
