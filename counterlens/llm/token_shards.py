"""Token shards: raw id payloads with a minimal perfect hash index for keyed access.

``write_shards`` sorts documents by ``doc_id`` over range partitions, encodes their
whole text, appends the end id and writes shard files of bounded size to a folder that
all executors share. It returns a manifest with one row a file; files of failed or
repeated task attempts have names of their own, and no manifest row names them.

File: 8 bytes length of a JSON header, the header (for each section its numpy type,
length and place), then the sections. ``ids`` is the raw payload, 2 bytes an id where
the vocabulary allows, else 4. ``ends`` holds each document's end in the payload,
``doc_ids`` the ids in order. The index is a minimal perfect hash over distinct ids: bit
arrays by level, each key owning the first level where it meets no other; the number of
bits before its own is its slot. A slot stores the key's fingerprint and its first
document. The fingerprint is a bijection of the 64-bit key, so an absent key is always
recognised.

Cases: null text is encoded as empty and still has its end id. Rows with equal
``doc_id`` are all stored, ordered by a hash of their text, and a lookup returns all of
them. Rows without an id come first and have no key. An empty table gives no file and an
empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from counterlens.llm import kernel as K
from counterlens.llm.merging import LONGEST, PairMerges
from counterlens.llm.shared import Scratch
from counterlens.llm.units import UnitCache

END_ID = 1
SHARD_IDS = 16_000_000
NO_ID = int(np.iinfo(np.int64).min)
MANIFEST = "part int, seq int, uri string, first_id long, last_id long, n_docs long, n_ids long"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.places = np.concatenate(([0], np.cumsum(sizes // 64))).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(keys + K.U64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % K.U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, rest = [], [np.zeros(0, K.U64)], keys.astype(K.U64)
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            spot = cls._spot(rest, len(sizes), size)
            alone = np.bincount(spot, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(K.U64))
            sizes.append(size)
            rest = rest[~alone[spot]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; for a key that was not given, any slot or -1."""
        keys = np.asarray(keys).astype(K.U64)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            spot = self._spot(keys[rest], level, int(size))
            word = self.places[level] + (spot >> 6)
            bit = (spot & 63).astype(K.U64)
            hit = (self.bits[word] >> bit) & K.U64(1) == 1
            before = self.bits[word] & ((K.U64(1) << bit) - K.U64(1))
            out[rest[hit]] = (self.rank[word] + np.bitwise_count(before))[hit]
            rest = rest[~hit]
        return out


def pack_shard(doc_ids: np.ndarray, n_null: int, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard file; the first n_null documents have no key."""
    keys, first = np.unique(doc_ids[n_null:], return_index=True)
    index = PerfectHash.build(keys.view(K.U64))
    slot = index.slots(keys.view(K.U64))
    prints, firsts = np.zeros(len(keys), K.U64), np.zeros(len(keys), np.uint32)
    prints[slot], firsts[slot] = K.mix(keys.view(K.U64)), first + n_null
    sections = {"doc_ids": doc_ids, "ends": ends, "sizes": index.sizes, "bits": index.bits, "prints": prints, "firsts": firsts, "ids": ids}
    table, at = {"n_null": int(n_null)}, 0
    for name, x in sections.items():
        table[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(table).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in sections.values())
    return len(head).to_bytes(8, "little") + head + body


class Shard:
    """A shard file read back."""

    def __init__(self, data: bytes):
        n = int.from_bytes(data[:8], "little")
        head = json.loads(data[8 : 8 + n])
        self.n_null = head.pop("n_null")
        for name, (kind, count, at) in head.items():
            setattr(self, name, np.frombuffer(data, kind, count, 8 + n + at))
        self.index = PerfectHash(self.sizes, self.bits)

    @classmethod
    def open(cls, uri: str) -> Shard:
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            return cls(f.read())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first document of each key, -1 where the shard does not have it."""
        keys = np.asarray(keys, np.int64)
        if not len(self.prints):
            return np.full(len(keys), -1)
        slot = self.index.slots(keys.view(K.U64))
        hit = (slot >= 0) & (self.prints[slot] == K.mix(keys.view(K.U64)))
        return np.where(hit, self.firsts[slot].astype(np.int64), -1)

    def document(self, place: int) -> np.ndarray:
        return self.ids[self.ends[place - 1] if place else 0 : self.ends[place]]

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every document with this key."""
        place, out = int(self.find(np.array([key]))[0]), []
        while 0 <= place < len(self.doc_ids) and self.doc_ids[place] == key:
            out.append(self.document(place))
            place += 1
        return out


# Bytes that byte-level vocabularies print as themselves.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_HIDDEN = [b for b in range(256) if b not in PRINTED]
BYTE_CHARS = {**{b: chr(b) for b in PRINTED}, **{b: chr(256 + i) for i, b in enumerate(_HIDDEN)}}
TAIL = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")  # the pattern has words of its own after an apostrophe


# How files of the form that the encoder reads prepare a text. Words between white space are then apart, and runs of letters one piece.
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def read_form(path: str) -> dict:
    """The model of a tokenizer file; a file that prepares texts in another way is refused, as its ids would be wrong."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    odd = [k for k, v in FORM.items() if data.get(k) != v] + [k for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or odd:
        raise ValueError(f"{path} is not of the form that is read here: {', '.join(odd) or 'model'}")
    return model


class WordEncoder:
    """Ids of words between white space, by the tokenizers library.

    The tokenizer drops white space and treats words apart from each other, so a word
    has the same ids in any text. A word that is one run of letters, perhaps with
    punctuation after it, is merged here by the file's rules, many words at once; any
    other goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.dtype = "<u2" if len(vocab) <= 1 << 16 else "<u4"
        model = read_form(path)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[side]] for m in rules], np.int64) for side in (0, 1))
        made = np.array([vocab[a + b] for a, b in rules])
        self.merges = PairMerges(left, right, np.arange(len(rules)), made)
        end = model.get("end_of_word_suffix") or ""
        self.inner, self.final = (np.array([vocab[BYTE_CHARS[x] + suffix] for x in range(256)], np.int32) for suffix in ("", end))
        self.runs: dict[str, bytes] = {}
        self.cache = UnitCache(self.encode, self.dtype)

    def _learn(self, runs: list[str]) -> None:
        """Merge runs that are one piece each for the tokenizer."""
        raw = [r.encode() for r in runs]
        lengths = np.array([len(r) for r in raw])
        flat, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.final[flat[ends - 1]]
        ids, per = self.merges(symbols, lengths)
        data = ids.astype(self.dtype).tobytes()
        upto = (np.concatenate(([0], np.cumsum(per))) * np.dtype(self.dtype).itemsize).tolist()
        self.runs.update(zip(runs, [data[i:j] for i, j in zip(upto, upto[1:])]))

    def encode(self, words: list[bytes]) -> list[bytes]:
        runs = self.runs
        if len(runs) >= 400_000:
            runs.clear()
        text = b"\n".join(words).decode()  # no word holds white space
        parts: list[tuple[str, str] | None] = []
        add, whole = parts.append, text.split("\n")
        for i, low in enumerate(text.lower().split("\n")):
            base = low.rstrip(TAIL)
            if not base.isalpha():
                add(None)
            elif low.isascii():
                add((base, low[len(base) :]) if len(low) <= LONGEST else None)
            else:
                plain = len(low.encode()) <= LONGEST and "Σ" not in whole[i] and unicodedata.is_normalized("NFC", whole[i])
                add((base, low[len(base) :]) if plain else None)
        new = {r for part in parts if part for r in part if r and r not in runs}
        if new:
            self._learn(list(new))
        runs[""] = b""
        out = [runs[part[0]] + runs[part[1]] if part else b"" for part in parts]
        other = [i for i, part in enumerate(parts) if not part]
        if other:
            made = self.tokenizer.encode_batch_fast([words[i].decode() for i in other], add_special_tokens=False)
            for i, x in zip(other, made):
                out[i] = np.array(x.ids, self.dtype).tobytes()
        return out


_encoders: dict[str, WordEncoder] = {}
K.LETS_GO["token_shards"] = _encoders.clear


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _write(folder: str, path: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("token_shards")
        enc, task = encoder(path), TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        held, size, seq = [], 0, 0

        def flush() -> pa.RecordBatch:
            doc_ids, valid, lengths, ids = (np.concatenate(x) for x in zip(*held))
            name = f"shard-{task.partitionId():06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(pack_shard(doc_ids, int((~valid).sum()), np.cumsum(lengths), ids))
            return pa.record_batch([pa.array([x], f.type) for x, f in zip((task.partitionId(), seq, f"{folder}/{name}", int(doc_ids[0]), int(doc_ids[-1]), len(doc_ids), len(ids)), schema)], schema=schema)

        for part in K.chunks(batches, "text", owner="token_shards"):
            buf, offs = K.utf8(part.column("text"))
            starts, ends, first = K.words(buf, offs)
            ids, per = enc.cache(buf, starts, ends)
            upto = np.concatenate(([0], np.cumsum(per)))[first]
            ids = np.insert(ids, upto[1:], end_id)
            key = part.column("doc_id").cast(pa.int64())
            held.append((key.fill_null(NO_ID).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False), np.diff(upto) + 1, ids))
            size += len(ids)
            if size >= SHARD_IDS:
                yield flush()
                held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, scratch: Scratch, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the shard files of ``docs``; the manifest has start, the ids before each file. A tokenizer file of another form is an error."""
    read_form(tokenizer)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    ordered = slim.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    made = scratch.table(ordered.mapInArrow(_write(scratch.path("shards"), tokenizer, end_id), MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def _read():
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard.open(uri)
                keyed = shard.doc_ids[shard.n_null :]
                place = shard.find(keyed)
                if (place < 0).any() or (shard.doc_ids[place] != keyed).any():
                    raise ValueError(f"the index of {uri} does not lead to its documents")
                begins = np.concatenate(([0], shard.ends[:-1]))
                wide = shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(begins.tolist(), shard.ends.tolist())]
                ids = pa.array(shard.doc_ids, mask=np.arange(len(shard.doc_ids)) < shard.n_null)
                yield pa.record_batch([ids, pa.array(begins + start, pa.int64()), pa.array(shard.ends - begins, pa.int64()), pa.array(crc, pa.int64()), pa.array([uri] * len(ids), pa.string())], schema=schema)

    return run


def read_shards(manifest: DataFrame, n_files: int) -> DataFrame:
    """One row a stored document, from the files that the manifest names."""
    spread = manifest.select("uri", "start").repartition(max(1, min(n_files, 10_000)), "uri")
    return spread.mapInArrow(_read(), "doc_id long, start long, n_tokens long, ids_crc32 long, uri string")


def lookup(manifest: DataFrame, key: int) -> list[np.ndarray]:
    """Ids of every document with this key: the manifest's ranges name the files to ask."""
    rows = manifest.where((F.col("first_id") <= key) & (F.col("last_id") >= key)).orderBy("part", "seq").select("uri").collect()
    return [x for r in rows for x in Shard.open(r.uri).get(key)]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "tokens")
    manifest = write_shards(docs, scratch, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(manifest, manifest.count()).drop("uri")
