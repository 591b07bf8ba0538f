"""Byte-level BPE by dynamic programming over prefixes.

Text is split by a pattern and each match is encoded separately. Of a match, every byte
prefix has one valid encoding, and the table ``last`` stores the last token of that
encoding for each prefix length. A token that ends at ``i`` is that last token exactly
if merging its bytes with those of ``last`` at its start leaves the two as they are; this
is asked once for each pair of tokens and remembered. Walking back through ``last`` gives
the ids. The tables of many matches are filled together: tokens that start at a place are found
by walking a tree of all tokens, and the entries of one prefix length of all matches are
asked at once. Because a prefix's entry depends on earlier bytes only, text is appended by
growing the table, and an edit recomputes entries from its place until they agree with
the old ones again.

Cases: null text is empty; an empty text has no ids and decodes to no bytes. Matches of
any length are encoded in time linear in their length; those of over 64 bytes one by one. Rows with equal ids or texts are
encoded each by itself and agree. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from counterlens.llm import kernel as K
from counterlens.llm.merging import LONGEST, IntTable, PairMerges
from counterlens.llm.units import UnitCache

# The code points that the pattern's \s stands for.
FAR_WHITE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = "\t-\r " + FAR_WHITE
TOGETHER = 64  # bytes of a match up to which tables are filled together


class PrefixBpe:
    """Encoder over a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.cuts = pattern == public_tokenizers.PATTERN  # of another pattern it is not known where texts may be cut
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        out, in_class = "", False  # \s is another set in this regex library
        for part in regex.findall(r"\\.|.", pattern):
            in_class = part == "[" or in_class and part != "]"
            out += part if part not in ("\\s", "\\S") else (WHITE if part == "\\s" else "") if in_class else f"[{'^' if part == chr(92) + 'S' else ''}{WHITE}]"
        self.split = regex.compile(out).findall
        self.dtype = "<u2" if len(self.tokens) <= 1 << 16 else "<u4"
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.fits, self.tree = IntTable(-1), None
        self.cache = UnitCache(self._units, self.dtype)

    @classmethod
    def load(cls, path: str, pattern: str) -> PrefixBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank, for strings of two tokens at most."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _fits(self, left: int, token: int) -> bool:
        key = left << 20 | token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.tokens[left] + self.tokens[token]) == [left, token]
        return known

    def _starts(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.tokens[token]) == [token]
        return known

    def _entry(self, piece: bytes, last: list[int], i: int) -> int:
        ranks, pairs = self.ranks, self.pairs
        for j in range(max(0, i - self.longest), i):
            token = ranks.get(piece[j:i])
            if token is not None:
                if j:
                    fits = pairs.get(last[j] << 20 | token)
                    if fits or fits is None and self._fits(last[j], token):
                        return token
                elif self._starts(token):
                    return token
        raise ValueError("the vocabulary lacks a byte")

    def table(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """Last tokens of all prefixes; ``last`` may hold those of a shorter prefix."""
        last = [-1] if last is None else last
        for i in range(len(last), len(piece) + 1):
            last.append(self._entry(piece, last, i))
        return last

    def edit(self, piece: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The piece and table after ``removed`` bytes at ``at`` give way to ``added``."""
        new = piece[:at] + added + piece[at + removed :]
        out, shift, same = last[: at + 1], len(added) - removed, 0
        while len(out) <= len(new):
            i = len(out)
            if same >= self.longest and i - at - len(added) >= self.longest:
                out += last[i - shift :]
                break
            out.append(self._entry(new, out, i))
            same = same + 1 if i > at + len(added) and out[i] == last[i - shift] else 0
        return new, out

    def walk(self, last: list[int]) -> list[int]:
        ids, i = [], len(last) - 1
        while i:
            ids.append(last[i])
            i -= len(self.tokens[last[i]])
        return ids[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.table(piece))

    def _grow(self) -> None:
        """Tree of all tokens, merges of pairs, and the tokens that are their own encoding."""
        tokens, ranks = self.tokens, self.ranks
        rows, ends = [{}], [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = rows[node].get(byte)
                if nxt is None:
                    nxt = rows[node][byte] = len(rows)
                    rows.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = rank
        inner = np.cumsum([bool(r) for r in rows]) - 1  # only nodes with children have a row
        self.child = np.full((int(inner[-1]) + 1, 256), -1, np.int32)
        for row, kids in zip(inner.tolist(), rows):
            if kids:
                self.child[row, list(kids)] = list(kids.values())
        self.row = np.where([bool(r) for r in rows], inner, -1).astype(np.int32)
        self.token_at = np.array(ends, np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.merges = PairMerges(left, right, made, np.arange(len(tokens)))
        self.size = np.array([len(t) for t in tokens])
        self.first = np.cumsum(self.size) - self.size
        single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.single = single[np.frombuffer(b"".join(tokens), np.uint8)]
        self.alone = np.zeros(len(tokens), bool)
        known = np.flatnonzero((self.size > 0) & (self.size <= LONGEST))
        ids, per = self.merges(self._bytes_of(known), self.size[known])
        self.alone[known] = (per == 1) & (ids[np.cumsum(per) - per] == known)
        for t in np.flatnonzero(self.size > LONGEST).tolist():
            self.alone[t] = self._starts(t)
        self.tree = True

    def _bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """Single-byte tokens of the bytes of ``ids``, in order."""
        per = self.size[ids]
        return self.single[np.arange(int(per.sum())) + np.repeat(self.first[ids] - (np.cumsum(per) - per), per)]

    def _fit(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one at its left; what is not known is merged and kept."""
        key = left.astype(np.int64) << 20 | token
        got = self.fits.get(key)
        asked = np.unique(key[got < 0])
        if len(asked):
            a, b = asked >> 20, asked & 0xFFFFF
            per, ok = self.size[a] + self.size[b], np.zeros(len(asked), np.int32)
            short = np.flatnonzero(per <= LONGEST)
            both = np.stack((a[short], b[short]), 1).ravel()
            ids, left_over = self.merges(self._bytes_of(both), per[short])
            at, two = np.cumsum(left_over) - left_over, left_over == 2
            at = at[two]
            ok[short[two]] = (ids[at] == a[short[two]]) & (ids[at + 1] == b[short[two]])
            for i in np.flatnonzero(per > LONGEST).tolist():
                ok[i] = self._fits(int(a[i]), int(b[i]))
            if self.fits.count + len(asked) > 1_000_000:
                self.fits.clear()
            self.fits.add(asked, ok)
            new = got < 0
            got[new] = ok[np.searchsorted(asked, key[new])]
        return got == 1

    def tables(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Last tokens of the prefixes of many non-empty pieces, longest piece first.

        Entry (i, k) of the first result is for the first i + 1 bytes of piece ``order[k]``;
        the second is ``order``.
        """
        if not self.tree:
            self._grow()
        lengths = np.array([len(x) for x in pieces])
        order = np.argsort(-lengths, kind="stable")
        ordered, width = lengths[order], int(lengths.max())
        flat, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths
        inside = np.arange(width)[:, None] < ordered
        data = np.zeros(inside.shape, np.uint8)
        data[inside] = flat[(begin[order] + np.arange(width)[:, None])[inside]]
        upto = inside.sum(1).tolist()  # pieces that reach each place
        met: list[list] = [[] for _ in range(width)]  # by last byte: first byte, pieces, tokens
        for start in range(width):
            who, row = np.arange(upto[start]), np.zeros(upto[start], np.int32)
            for end in range(start, width):
                live = who < upto[end]
                who, row = who[live], row[live]
                node = self.child[row, data[end, who]]
                live = node >= 0
                who, node = who[live], node[live]
                if not len(who):
                    break
                token = self.token_at[node]
                is_token = token >= 0
                met[end].append((start, who[is_token], token[is_token]))
                row = self.row[node]
                live = row >= 0
                who, row = who[live], row[live]
        last = np.full(data.shape, -1, np.int32)
        for end in range(width):
            for start, who, token in met[end]:  # longest first
                unset = last[end, who] < 0
                who, token = who[unset], token[unset]
                good = self._fit(last[start - 1, who], token) if start else self.alone[token]
                last[end, who[good]] = token[good]
            met[end] = []
        if (last[inside] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return last, order

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of pieces of 1 to TOGETHER bytes that are no tokens."""
        last, order = self.tables(pieces)
        n = len(pieces)
        on, who = np.zeros(last.shape, bool), np.arange(n)
        at = np.array([len(pieces[k]) for k in order.tolist()]) - 1
        while len(who):  # back through the last tokens, all pieces at once
            on[at, who] = True
            at = at - self.size[last[at, who]]
            who, at = who[at >= 0], at[at >= 0]
        data = last.T[on.T].astype(self.dtype).tobytes()
        upto = (np.concatenate(([0], np.cumsum(on.sum(0)))) * np.dtype(self.dtype).itemsize).tolist()
        out = [b""] * n
        for i, k in enumerate(order.tolist()):
            out[k] = data[upto[i] : upto[i + 1]]
        return out

    def _units(self, units: list[bytes]) -> list[bytes]:
        pieces, ranks = self.pieces, self.ranks
        if len(pieces) >= 400_000:
            pieces.clear()
        split = [self.split(u.decode()) for u in units]
        many: list[str] = []
        for piece in {p for parts in split for p in parts if p not in pieces}:
            raw = piece.encode()
            whole = ranks.get(raw)
            if whole is not None:
                pieces[piece] = whole.to_bytes(np.dtype(self.dtype).itemsize, "little")
            elif len(raw) > TOGETHER:
                pieces[piece] = np.array(self.walk(self.table(raw)), self.dtype).tobytes()
            else:
                many.append(piece)
        for i in range(0, len(many), 50_000):
            some = many[i : i + 50_000]
            pieces.update(zip(some, self.encode_pieces([p.encode() for p in some])))
        return [pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts]) for parts in split]

    def _text(self, text: str) -> bytes:
        return self._units([text.encode()])[0]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._text(text), self.dtype)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's offset.

        A text is cut where a match must end whatever surrounds it: after a word, and
        before the last character of the white space between words. Texts with white
        space outside ASCII are not cut.
        """
        buf, offs = K.utf8(column)
        starts, ends, first = K.words(buf, offs)
        n = len(buf)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(offs), np.int64)
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        if not self.cuts:
            at = np.flatnonzero(cut)
            ids, per = self.cache(buf, at[:-1], at[1:])
            return ids, np.concatenate(([0], np.cumsum(per)))[np.searchsorted(at, offs)]
        cut[ends] = True
        head = starts[~cut[starts]]  # words after white space of their own text
        cut[head - 1] = True
        solid = head[buf[head - 1] != 0x20]
        cut[solid] = True
        rare = np.zeros(n, bool)
        for lead in (0xC2, 0xE1, 0xE2, 0xE3):
            rare |= buf == lead
        for d in np.unique(np.searchsorted(offs, np.flatnonzero(rare), side="right") - 1).tolist():
            a, b = int(offs[d]), int(offs[d + 1])
            if regex.search(f"[{FAR_WHITE}]", bytes(buf[a:b]).decode()):
                cut[a + 1 : b] = False
        at = np.flatnonzero(cut)
        ids, per = self.cache(buf, at[:-1], at[1:])
        upto = np.concatenate(([0], np.cumsum(per)))
        return ids, upto[np.searchsorted(at, offs)]


class EncodedText:
    """A text kept with its matches and tables, for appends and edits."""

    def __init__(self, bpe: PrefixBpe, text: str = ""):
        self.bpe, self.text = bpe, ""
        self.parts: list[tuple[str, list[int]]] = []
        self.append(text)

    def _tail(self, keep: int, text: str) -> None:
        old = self.parts[keep:]
        self.parts = self.parts[:keep]
        for k, piece in enumerate(self.bpe.split(text)):
            raw, was = piece.encode(), old[k] if k < len(old) else None
            grown = was is not None and piece.startswith(was[0])
            self.parts.append((piece, self.bpe.table(raw, was[1] if grown else None)))

    def append(self, more: str) -> None:
        """Add text at the end; matches before the last two cannot change."""
        keep = max(0, len(self.parts) - 2)
        tail = "".join(p for p, _ in self.parts[keep:])
        self.text += more
        self._tail(keep, tail + more)

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace ``removed`` characters at ``at``; parts well before and after are kept."""
        self.text = self.text[:at] + added + self.text[at + removed :]
        keep = pos = 0
        while keep < len(self.parts) and pos + len(self.parts[keep][0]) <= at:
            pos += len(self.parts[keep][0])
            keep += 1
        for _ in range(min(2, keep)):
            keep -= 1
            pos -= len(self.parts[keep][0])
        known = dict(self.parts[keep:])
        self.parts = self.parts[:keep] + [(p, known[p] if p in known else self.bpe.table(p.encode())) for p in self.bpe.split(self.text[pos:])]

    @property
    def ids(self) -> list[int]:
        out = []
        for piece, last in self.parts:
            whole = self.bpe.ranks.get(piece.encode())
            out += [whole] if whole is not None else self.bpe.walk(last)
        return out


_loaded: dict[tuple[str, str], PrefixBpe] = {}
K.LETS_GO["bpe_prefix"] = _loaded.clear


def loaded(path: str, pattern: str) -> PrefixBpe:
    """One encoder a worker process, kept between tasks."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = PrefixBpe.load(path, pattern)
    return _loaded[path, pattern]


def _encode(path: str, pattern: str, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.enter("bpe_prefix")
        bpe = loaded(path, pattern)
        table = np.array([len(t) for t in bpe.tokens])
        flat = np.frombuffer(b"".join(bpe.tokens), np.uint8)
        begin = np.cumsum(table) - table
        for part in K.chunks(batches, "text", owner="bpe_prefix"):
            ids, offs = bpe.encode_column(part.column("text"))
            # bytes of all ids, by copying from the table of tokens
            per = table[ids]
            upto = np.concatenate(([0], np.cumsum(per)))
            back = flat[np.arange(int(upto[-1])) + np.repeat(begin[ids] - upto[:-1], per)]
            wide, cut = ids.astype("<u4"), upto[offs]
            spans = list(zip(offs.tolist(), offs[1:].tolist()))
            cols = [
                part.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(offs), pa.int64()),
                pa.array([hashlib.sha256(wide[a:b]).hexdigest() for a, b in spans], pa.string()),
                pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.string()),
            ]
            yield pa.record_batch(cols + [pa.array([wide[a:b].tobytes() for a, b in spans], pa.binary())] * with_ids, schema=schema)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False) -> DataFrame:
    """One row a document: counts and digests of its ids and of the decoded bytes.

    ``with_ids`` adds the ids themselves, as little-endian unsigned 32-bit integers.
    """
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_encode(path, pattern, with_ids), kind)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
