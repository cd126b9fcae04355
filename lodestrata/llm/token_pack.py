"""Token ids in a bit-packed table: every id takes the minimum bits of the vocabulary.

Layout. A packed folder holds Parquet rows, one per block: (shard, block, first, n_ids, bits, doc_ids,
doc_starts, data). Shards follow doc_id order and blocks are numbered in it. A block holds whole
documents, about ``block_ids`` ids; ``first`` is the id offset of the block within its shard,
``doc_starts`` the offset of each document within the block, and ``data`` the ids, id k at bits
[k * bits, (k + 1) * bits) with the least bit first. One id or a range of ids is read without unpacking
what stands before it. ``totals`` beside the blocks gives the ids of each shard.

Texts are range-partitioned by doc_id and encoded there, so what is shuffled is text, and each task
streams its sorted rows: its memory is one batch and one block.

Defined results: a null text is empty and encodes to the end id alone; rows without doc_id stand first;
equal doc_ids are ordered by the text's digest, and repeated rows are written once each; an empty table
gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, text_of

BLOCK_IDS = 65_536
END_ID = 1
MEMO = 800_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on; only their own bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count, offset=start * bits // 8).astype(np.uint32)
    at = start * bits
    raw = np.frombuffer(data, dtype=np.uint8, count=(at + count * bits + 7) // 8 - at // 8, offset=at // 8)
    own = np.unpackbits(raw, bitorder="little")[at % 8 :][: count * bits].reshape(count, bits)
    return own.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Encoder:
    """Ids of texts by a tokenizers file whose pre-tokeniser drops white space.

    Such a tokenizer encodes the pieces between spaces on their own, so the ids of common pieces are
    remembered (up to ``MEMO`` of them) and a batch's ids are gathered from one flat array. New pieces are
    encoded many in a text, with a control character between them whose id shows where each ends. Where it
    lower-cases and splits words from punctuation, a text is lower-cased first, if that is the same, and a
    new word that ends in a comma or full stop has the word's ids and the mark's.
    """

    MARK, MANY, CHARS = "\x01", 512, 4_000_000
    _own: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._ids(self.MARK)
        self.mark = int(mark[0]) if len(mark) == 1 and len(self._ids(f"a {self.MARK} a")) == 3 else None
        # ids that end a word, where the vocabulary marks them: a word of letters is one such run
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=bool)
        ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.ends = ends if [bool(ends[i]) for i in self._ids("a b")] == [True, True] else None
        self.specials = [str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        # both hold if these agree
        self.lowers = bool(np.array_equal(self._ids("TheRe"), self._ids("there"))) and bool(np.array_equal(self._ids("there,"), np.append(self._ids("there"), self._ids(","))))
        self.clear()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """This Python worker's encoder: what it has remembered serves later tasks too."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.starts, self.lengths = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _text(self, text: str) -> str:
        if self.lowers and "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            low = text.lower()
            text = low if low.isascii() or unicodedata.is_normalized("NFC", low) else text
        return text.replace("\n", " ").replace("\t", " ")

    def _learn(self, new: list[str]) -> None:
        """Learn pieces, those that end in a mark from what stands before it."""
        if self.lowers:
            ended = [p for p in new if p[-1:] in (",", ".") and p[:-1].isalpha()]
            if ended:
                skip = set(ended)
                heads = {p[:-1] for p in ended}
                self._encode([p for p in heads.union(new, ",.") if p not in skip and p not in self.index])
                place = np.array([(self.index[p[:-1]], self.index[p[-1]]) for p in ended])
                self._add(ended, self._gather(place.reshape(-1)), self.lengths[place].sum(axis=1))
                return
        self._encode(new)

    def _add(self, names: list[str], got: np.ndarray, n: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names))))
        while self.used + len(got) > len(self.flat):
            self.flat = np.append(self.flat, np.empty_like(self.flat))
        self.flat[self.used : self.used + len(got)] = got
        self.starts = np.append(self.starts, self.used + np.cumsum(n) - n)
        self.lengths = np.append(self.lengths, n)
        self.used += len(got)

    def _encode(self, new: list[str]) -> None:
        if not new:
            return
        plain = self.mark is not None
        odd = new if not plain else []
        if plain and any(x in " ".join(new) for x in (self.MARK, *self.specials)):
            odd = [p for p in new if any(x in p for x in (self.MARK, *self.specials))]
        if odd:
            skip = set(odd)
            new = [p for p in new if p not in skip]
        names, parts, lengths = [], [], []
        if self.ends is not None:
            alpha = [p for p in new if p.isalpha()]
            for i in range(0, len(alpha), self.MANY):
                some = alpha[i : i + self.MANY]
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                last = np.flatnonzero(self.ends[ids])
                if len(last) == len(some) and last[-1] == len(ids) - 1:
                    names += some
                    parts.append(ids)
                    lengths.append(np.diff(np.append(-1, last)))
            done = set(names)
            new = [p for p in new if p not in done]
        for i in range(0, len(new), self.MANY):
            some = new[i : i + self.MANY]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            names += some
            parts.append(ids[ids != self.mark])
            lengths.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
        for p in odd:
            names.append(p)
            parts.append(self._ids(p))
            lengths.append(np.array([len(parts[-1])]))
        n, got = np.concatenate(lengths), np.concatenate(parts)
        if len(n) != len(names) or n.sum() != len(got):
            raise ValueError("the tokenizer joins pieces across the mark")
        self._add(names, got, n)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out, some, chars = [], [], 0
        for t in texts:
            some.append(t)
            chars += len(t)
            if chars >= self.CHARS:
                out += self._some(some)
                some, chars = [], 0
        return out + (self._some(some) if some else [])

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of bounded length together: each different piece is looked up once."""
        if len(self.index) > MEMO:
            self.clear()
        lists = pc.split_pattern(pa.array(list(map(self._text, texts)), pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        names, get = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), self.index.get
        places = list(map(get, names))
        missing = [(j, names[j]) for j, k in enumerate(places) if k is None] if None in places else []
        if missing:
            self._learn([p for _, p in missing])
            for j, p in missing:
                places[j] = get(p)
        at = np.array(places, dtype=np.int64)[pieces.indices.to_numpy()]
        ids = self._gather(at)
        ends = np.append(0, np.cumsum(self.lengths[at]))[lists.offsets.to_numpy()]
        return [ids[i:j] for i, j in zip(ends[:-1], ends[1:])]

    def _gather(self, at: np.ndarray) -> np.ndarray:
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[at] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def vocabulary_bits(path: str) -> int:
    from tokenizers import Tokenizer

    return max(1, (Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1).bit_length())


def write_packed(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode (doc_id, text) and write the packed table to ``out``/blocks and ``out``/totals."""
    spark = docs.sparkSession
    small_batches(spark)
    bits = max(vocabulary_bits(tokenizer_path), int(end_id).bit_length())

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, shard = Encoder.of(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        names, parts, held, first, number = [], [], 0, 0, 0

        def block() -> pd.DataFrame:
            nonlocal names, parts, held, first, number
            lengths = np.array([len(x) for x in parts], dtype=np.int64)
            row = {
                "shard": shard, "block": number, "first": first, "n_ids": held, "bits": bits,
                "doc_ids": names, "doc_starts": np.cumsum(lengths) - lengths,
                "data": pack(np.concatenate(parts), bits)}
            names, parts, held, first, number = [], [], 0, first + held, number + 1
            return pd.DataFrame([row])

        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for name, got in zip([None if pd.isna(i) else int(i) for i in ids], encoder(list(batch["text"]))):
                names.append(name)
                parts.append(np.append(got, end))
                held += len(got) + 1
                if held >= block_ids:
                    yield block()
        if names:
            yield block()

    schema = "shard int, block int, first long, n_ids long, bits int, doc_ids array<long>, doc_starts array<long>, data binary"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", text_of().alias("text"))
    ordered = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.md5("text"))
    ordered.mapInPandas(blocks, schema).write.option("compression", "none").parquet(f"{out}/blocks")
    spark.read.parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).write.parquet(f"{out}/totals")


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the packed table."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    totals = spark.read.parquet(f"{path}/totals").select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    rows = spark.read.parquet(f"{path}/blocks").join(totals, "shard")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = unpack(r.data, r.bits, 0, r.n_ids).astype("<u4")
                starts = np.asarray(r.doc_starts, dtype=np.int64)
                ends = np.append(starts[1:], r.n_ids)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                names = pd.array([None if pd.isna(i) else int(i) for i in r.doc_ids], dtype="Int64")
                yield pd.DataFrame({"doc_id": names, "start": r.before + r.first + starts, "n_tokens": ends - starts, "ids_crc32": crc})

    return rows.select("first", "n_ids", "bits", "doc_ids", "doc_starts", "data", "before").mapInPandas(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, shard: int, start: int, count: int) -> np.ndarray:
    """Random access: ``count`` ids of a shard from id ``start`` on; only the blocks that hold them are read."""
    near = spark.read.parquet(f"{path}/blocks").where((F.col("shard") == shard) & (F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start))
    out = []
    for r in near.orderBy("first").collect():
        a, b = max(start, r["first"]), min(start + count, r["first"] + r["n_ids"])
        out.append(unpack(bytes(r["data"]), r["bits"], a - r["first"], b - a))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "packed")
    write_packed(docs, path, tokenizer_path or default_tokenizer())
    return read_packed(spark, path)


def op2_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
