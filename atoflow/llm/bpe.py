"""Byte-level BPE by a distinct-word table: each distinct word is encoded once, ids join back by position."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atoflow.llm.common import shared_table

#: White space by the Unicode property of that name (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level split of a text into words (fixed pattern of the vocabulary).
SPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Characters of text after which a task closes a block of documents.
BLOCK_CHARS = 16 << 20
#: The words of all blocks are dealt by hash to so many shares for each shuffle partition.
SHARES_PER_PARTITION = 4


class Splitter:
    """Words of a whole text in order; marks of the vocabulary's special tokens are words of their own."""

    def __init__(self, special: list[str]):
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special is None:
            return SPLIT.findall(text)
        parts = self.special.split(text)
        if len(parts) == 1:
            return SPLIT.findall(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else SPLIT.findall(part))]


def special_tokens(vocabulary: str) -> list[str]:
    """Contents of the added tokens of a tokenizer file (JSON text)."""
    return [t["content"] for t in json.loads(vocabulary).get("added_tokens", [])]


def piece_table(vocabulary: str) -> list[bytes]:
    """Bytes of each id: the file's characters stand for bytes, printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    spec = json.loads(vocabulary)
    size = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    out = [b""] * size
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(of[c] for c in piece)
    for t in spec.get("added_tokens", []):
        out[t["id"]] = t["content"].encode()
    return out


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane: the high planes are mostly zero."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _ranges(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Concatenation of ``starts[i] + arange(lengths[i])``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


BLOCK_SCHEMA = "block string, share int, ids binary, lens binary, body binary, places binary"


def split_blocks(docs: DataFrame, vocabulary: str, shares: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Split all texts into words, block by block.

    A block (some documents of one task) gives one row with share -1: its document numbers, words
    per document, the words as ranks by frequency within the block (small numbers, which pack well),
    and the ranks in the order of the shares; and one row for each share that some of its distinct
    words fall into: these words, once each and sorted.
    """
    special = special_tokens(vocabulary)

    def rows(name, uids, counts, numbers, table):
        keys = [w.encode("utf-8", "surrogatepass") for w in table]
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
        rank = np.empty(len(keys), np.uint32)
        rank[np.argsort(-np.bincount(flat, minlength=len(keys)), kind="stable")] = np.arange(len(keys), dtype=np.uint32)
        share = [zlib.crc32(w) % shares for w in keys]
        order = sorted(range(len(keys)), key=lambda i: (share[i], keys[i]))
        yield (name, -1, _pack(np.array(uids, np.int64)), _pack(np.array(counts, np.int64)), _pack(rank[flat]), _pack(rank[order]))
        for s, own in itertools.groupby(order, key=share.__getitem__):
            own = [keys[i] for i in own]
            yield (name, s, b"", _pack(np.array([len(w) for w in own], np.uint32)),
                   zstandard.ZstdCompressor(level=3).compress(b"".join(own)), b"")

    def batch(found):
        cols = list(zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
            names=["block", "share", "ids", "lens", "body", "places"])

    def run(batches):
        from pyspark import TaskContext

        split, part, at = Splitter(special), TaskContext.get().partitionId(), 0
        uids, counts, numbers, table, chars = [], [], [], {}, 0
        for b in batches:
            for uid, text in zip(b.column("uid").to_pylist(), b.column("text")):
                text = text.as_py() or ""
                w = split(text)
                uids.append(uid)
                counts.append(len(w))
                numbers.append(np.fromiter((table.setdefault(x, len(table)) for x in w), np.uint32, len(w)))
                chars += len(text)
                if chars >= block_chars:
                    yield batch(list(rows(f"{part}-{at}", uids, counts, numbers, table)))
                    uids, counts, numbers, table, chars, at = [], [], [], {}, 0, at + 1
        if uids:
            yield batch(list(rows(f"{part}-{at}", uids, counts, numbers, table)))

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def encode_words(blocks: DataFrame, vocabulary) -> DataFrame:
    """Ids of the blocks' words: rows ``(block, share, ids, lens)``.

    All words of a share meet in one task, share after share, so each distinct word is encoded
    once; a word has at most one entry a block, however often the texts use it.
    """
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(vocabulary.value)
        tok.no_truncation()
        tok.no_padding()
        known, share = {}, None
        for b in batches:
            out = []
            for block, s, lens, body in zip(*(b.column(c).to_pylist() for c in ("block", "share", "lens", "body"))):
                if s != share:
                    known, share = {}, s
                raw, n = zstandard.ZstdDecompressor().decompress(body), _unpack(lens, np.uint32).astype(np.int64)
                ends = np.cumsum(n).tolist()
                words = [raw[a:z] for a, z in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                for w, e in zip(new, tok.encode_batch([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)):
                    known[w] = e.ids
                got = [known[w] for w in words]
                out.append((block, s, _pack(np.array([i for x in got for i in x], np.uint32)), _pack(np.array([len(x) for x in got], np.uint32))))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())],
                    names=["block", "share", "ids", "lens"])

    dealt = blocks.filter("share >= 0").select("block", "share", "lens", "body").repartition("share").sortWithinPartitions("share")
    return dealt.mapInArrow(run, "block string, share int, ids binary, lens binary")


def _block_ids(left: pa.Table, right: pa.Table):
    """Of one block: (uid, ids as an array) per document, in order."""
    right = right.sort_by("share")
    per_word = [_unpack(x, np.uint32) for x in right["lens"].to_pylist()]
    ids = [_unpack(x, np.uint32) for x in right["ids"].to_pylist()]
    lens = np.concatenate(per_word).astype(np.int64) if per_word else np.zeros(0, np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    for u, c, n, p in zip(*(left[x].to_pylist() for x in ("ids", "lens", "body", "places"))):
        place, numbers, at = _unpack(p, np.uint32), _unpack(n, np.uint32), 0
        length, start = np.zeros((2, len(place)), np.int64)
        length[place], start[place] = lens, np.cumsum(lens) - lens
        for uid, count in zip(_unpack(u, np.int64).tolist(), _unpack(c, np.int64).tolist()):
            own = numbers[at:at + count]
            at += count
            yield uid, flat[_ranges(length[own], start[own])]


def join_back(blocks: DataFrame, ids: DataFrame, each, schema: str) -> DataFrame:
    """Meet each block's documents with the ids of its words; ``each(uid, ids)`` makes a row of ``schema``."""
    types = [f.strip().split(" ") for f in schema.split(",")]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(zip(*(each(uid, x) for uid, x in _block_ids(left, right)))) or [[] for _ in types]
        return pa.table([pa.array(c, arrow[t]) for c, (_, t) in zip(made, types)], names=[n for n, _ in types])

    docs = blocks.filter("share < 0").select("block", "ids", "lens", "body", "places")
    return docs.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, schema)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("uid"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
           shares: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows ``(uid, ids)`` of every text: its ids in order.  See :func:`encode_digests`."""
    blocks, ids, _ = _prepared(docs, vocabulary_path, id_col, text_col, shares, block_chars)
    return join_back(blocks, ids, lambda uid, x: (uid if uid != NULL_ID else None, x.astype(np.int32)), "uid long, ids array<int>")


#: Stands for a null id inside the packed blocks.
NULL_ID = -(1 << 63)


def _prepared(docs, vocabulary_path, id_col, text_col, shares, block_chars):
    with open(vocabulary_path, encoding="utf-8") as f:  # the driver's file; its text goes to the tasks
        vocabulary = f.read()
    shares = shares or SHARES_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary, some MB
    src = numbered(docs, id_col, text_col).withColumn("uid", F.coalesce("uid", F.lit(NULL_ID)))
    # bucketed by block, so the documents' words are written once and never shuffled
    blocks = shared_table(split_blocks(src, _slim(vocabulary), shares, block_chars), "word-blocks", "none", bucket="block")
    return blocks, encode_words(blocks, known), vocabulary


def _slim(vocabulary: str) -> str:
    return json.dumps({"added_tokens": json.loads(vocabulary).get("added_tokens", [])})


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text",
                   shares: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 (of the whole text's ids, decoded again).

    Equal to encoding each text alone without added special tokens; marks of special tokens in a
    text count as these tokens.  Decoding looks each id up in the table of pieces (as many rows as
    the vocabulary has ids, so it is sent to every task) and joins the bytes in order; bytes that are
    not UTF-8 become U+FFFD.  Null and empty texts have no ids.  Ids are whole numbers; repeated
    rows give a row each; other columns are not read; an empty table gives no rows.
    """
    blocks, ids, vocabulary = _prepared(docs, vocabulary_path, id_col, text_col, shares, block_chars)
    table = piece_table(vocabulary)
    lens = np.array([len(p) for p in table], np.int64)
    pieces = docs.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8), lens, np.cumsum(lens) - lens))

    def each(uid, x):
        return (uid if uid != NULL_ID else None, len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decode_ids(x, *pieces.value).encode()).hexdigest())

    out = join_back(blocks, ids, each, "uid long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("uid", id_col)


def decode_ids(ids: np.ndarray, body: np.ndarray, lens: np.ndarray, starts: np.ndarray) -> str:
    """Text of a list of ids: the pieces' bytes joined by position."""
    return body[_ranges(lens[ids], starts[ids])].tobytes().decode("utf-8", "replace")


def decode(tokens: DataFrame, pieces: DataFrame, id_col: str = "uid", ids_col: str = "ids") -> DataFrame:
    """Rows ``(id, text)`` from rows of ids and the table ``pieces(piece_id, bytes)``, by a join of ids to pieces.

    Unknown ids give nothing; a null or empty list gives an empty text; bytes that are not UTF-8
    become U+FFFD.
    """
    row = tokens.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    each = row.select("row", "id", F.posexplode_outer("ids").alias("pos", "piece_id"))
    found = each.join(F.broadcast(pieces), "piece_id", "left")
    whole = found.groupBy("row", "id").agg(F.sort_array(F.collect_list(
        F.struct("pos", F.coalesce("bytes", F.lit(b"")).alias("bytes")))).alias("parts"))
    return whole.select(F.col("id").alias(id_col), F.decode(F.aggregate(
        "parts", F.lit(b""), lambda a, p: F.concat(a, p["bytes"])), "UTF-8").alias("text"))
