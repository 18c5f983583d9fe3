"""SentencePiece encoding and decoding with seeded merge-dropout.

The encoder runs SentencePiece's BPE over its vocabulary: an agenda holds the candidate merges of neighbouring symbols,
best score first, the leftmost of equals first. With dropout, a candidate that comes up is skipped for good if a keyed
hash of it (key: seed, document id and number of the cut-out in the text; message: merged piece and position) falls
below the dropout rate. So each occurrence of a word is dealt its own pieces. The result needs no random state and
repeats exactly on any executor. A bounded cache holds what no key changes: the pieces of a word without dropout, and
the merges that lead to them. An occurrence none of whose merges is skipped has these pieces; any other is encoded anew.

No piece of such vocabularies has a blank after a non-blank or a line break anywhere, so texts are cut there and each
cut-out is encoded by itself; the constructor verifies that. Characters without a piece, and a literal U+2581 (which
stands for the blank in pieces), become byte pieces, so decoding gives back exactly the text that was encoded.

Defined results: a null text has null ids and decodes to null; an empty text has no ids; equal texts under equal ids
have equal pieces; an empty table gives no rows; columns beside id and text are kept by the operator's frame methods
under their own names, but one that is called as an added column (`ids`, `variant`, `decoded`, those in DIGEST) gives way
to it.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "piece_bpe_32k.model"
TOKENIZERS = "/opt/tokenizers"
DROPOUT, SEED = 0.1, 10
#: Words that a worker remembers.
CACHE = 300_000
#: Cut-outs of more characters go through the agenda one by one and are not remembered.
LONG = 64
#: Texts that are cut up at a time.
GROUP = 64
SPACE = "▁"
_CUT = re.compile(r"\n[^ \n]*| +[^ \n]*")
_MASK = (1 << 64) - 1
_PIECE, _POS, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _message(piece: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return piece.astype(np.uint64) * np.uint64(_PIECE) + pos.astype(np.uint64) * np.uint64(_POS)


def _hashed(message: np.ndarray, key) -> np.ndarray:
    """Keyed hashes; key: one for all messages, or one for each."""
    h = message ^ key
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MIX)
    return h ^ (h >> np.uint64(29))


def occurrence_keys(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Dropout keys of cut-outs, from the keys of their documents and their numbers in the text."""
    return _hashed((numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(_PIECE), keys)


class Codec:
    """Vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.table: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.table.append(b"")
            else:
                if SPACE in piece.lstrip(SPACE) or "\n" in piece:
                    raise ValueError(f"piece {i} crosses a blank or a line break; texts can't be cut there")
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
                self.table.append(piece.replace(SPACE, " ").encode())

    def pieces(self, symbols: list[str | None], key: int | None, rate: int) -> list[int]:
        """Ids of a run of characters (None: a literal U+2581). key: of the dropout, None for none; rate: of 2**64."""
        n = len(symbols)
        scores, ids = self.scores, self.ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if symbols[i] is not None and symbols[j] is not None:
                piece = symbols[i] + symbols[j]
                if piece in scores:
                    agenda.append((-scores[piece], i, j, piece)) if not ready else heapq.heappush(agenda, (-scores[piece], i, j, piece))

        ready = False
        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        ready = True
        gone = bytearray(n)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if gone[i] or gone[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(piece):
                continue
            if key is not None:
                h = ((ids[piece] * _PIECE + i * _POS) ^ key) & _MASK
                h = ((h ^ (h >> 32)) * _MIX) & _MASK
                if (h ^ (h >> 29)) < rate:
                    continue
            symbols[i] = piece
            gone[j] = 1
            nxt = after[i] = after[j]
            if nxt < n:
                before[nxt] = i
                offer(i, nxt)
            if before[i] >= 0:
                offer(before[i], i)
        out = []
        for i in range(n):
            if not gone[i]:
                s = symbols[i]
                known = ids.get(s) if s is not None else None
                if known is not None:
                    out.append(known)
                else:
                    out += [self.bytes[b] for b in (SPACE if s is None else s).encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode()
        return text[1:] if text[:1] == " " else text


class Batch:
    """Agenda processing of many cut-outs at once: in each round, every cut-out takes the merge on top of its agenda.

    A candidate's hash depends on nothing but its piece, its position and the key, so leaving skipped candidates out
    from the start gives what popping and skipping them would.
    """

    def __init__(self, codec: Codec):
        self.codec = codec
        order = sorted(codec.scores, key=lambda p: -codec.scores[p])
        rank, last = np.zeros(len(codec.table), np.int64), None
        for k, piece in enumerate(order):  # pieces of equal score share a rank, so the leftmost goes first
            rank[codec.ids[piece]] = k if last is None or codec.scores[piece] != codec.scores[order[k - 1]] else last
            last = int(rank[codec.ids[piece]])
        pairs = {}
        for piece, i in codec.ids.items():
            for k in range(1, len(piece)):
                left, right = codec.ids.get(piece[:k]), codec.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([*(pairs[k] for k in self.keys.tolist()), 0], np.int64)
        # A pair's place among the keys by its slot: behind the last if there is none, -1 where several keys share one.
        slots = self._slot(self.keys)
        self.place = np.full(1 << 20, len(self.keys), np.int32)
        self.place[slots] = np.arange(len(self.keys))
        self.place[np.bincount(slots, minlength=1 << 20) > 1] = -1
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.rank = rank
        self.chars = np.full(0x110000, -1, np.int64)
        for piece, i in codec.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i
        for c in range(128):  # one byte, one id; none of these takes part in a merge
            if self.chars[c] < 0:
                self.chars[c] = codec.bytes[c]
        self.chars[ord(" ")], self.chars[ord(SPACE)] = codec.ids[SPACE], -1

    _NONE = np.iinfo(np.int64).max

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.view(np.uint64) * np.uint64(_PIECE)) >> np.uint64(44)).view(np.int64)

    def _priority(self, left: np.ndarray, right: np.ndarray, pos: np.ndarray, key: np.ndarray | None, rate: int) -> tuple[np.ndarray, np.ndarray]:
        """For neighbouring symbols: the piece they merge to (0 for none) and the candidate's place in the agenda."""
        pair = np.where((left < 0) | (right < 0), -1, left << 20 | right)
        at = self.place[self._slot(pair)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.searchsorted(self.keys, pair[shared])
        valid = np.flatnonzero(self.keys[at] == pair)
        piece, prio = np.zeros(len(pair), np.int64), np.full(len(pair), self._NONE)
        piece[valid] = self.merged[at[valid]]
        if key is not None:
            valid = valid[_hashed(_message(piece[valid], pos[valid]), key[valid]) >= np.uint64(rate)]
        prio[valid] = self.rank[piece[valid]] << 20 | pos[valid]
        return piece, prio

    def encode(self, texts: list[str], keys: np.ndarray | None, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their number by text, messages of the merges made, their number by text). keys: one a text, or None for no dropout."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.chars[chars]
        word = np.repeat(np.arange(len(texts)), lens)
        pos = np.arange(len(sym)) - np.repeat(np.cumsum(lens) - lens, lens)
        same = np.zeros(len(sym), bool)
        same[:-1] = word[:-1] == word[1:]
        right = np.append(sym[1:], -1)
        of = (lambda w: None) if keys is None else keys.__getitem__
        piece, prio = self._priority(sym, np.where(same, right, -1), pos, of(word), rate)
        done = [(word[:0], sym[:0], pos[:0])]
        made = [(word[:0], piece[:0], pos[:0])]
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(prio, starts), sizes)
            active = best != self._NONE
            if not active.all():
                done.append((word[~active], sym[~active], pos[~active]))
                word, sym, pos, piece, prio, best = (x[active] for x in (word, sym, pos, piece, prio, best))
                if not len(sym):
                    break
            at = np.flatnonzero(prio == best)
            sym[at] = piece[at]
            if keys is None:
                made.append((word[at], piece[at], pos[at]))
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged symbols stand once their right halves are gone
            word, sym, pos, piece, prio = (x[stay] for x in (word, sym, pos, piece, prio))
            # Only the pairs with a merged symbol are new.
            for i in (moved, moved[moved > 0] - 1):
                nxt = np.minimum(i + 1, len(sym) - 1)
                other = np.where((nxt > i) & (word[nxt] == word[i]), sym[nxt], -1)
                piece[i], prio[i] = self._priority(sym[i], other, pos[i], of(word[i]), rate)
        word, sym, pos = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        word, sym, pos = word[order], sym[order], pos[order]
        odd = np.flatnonzero(sym < 0)
        if len(odd):  # characters without a piece, as bytes
            own = [[self.codec.bytes[c] for c in texts[w][p].encode()] for w, p in zip(word[odd].tolist(), pos[odd].tolist())]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = [len(b) for b in own]
            at = np.repeat(sym < 0, sizes)
            word, sym = np.repeat(word, sizes), np.repeat(sym, sizes)
            sym[at] = np.concatenate(own)
        owner, piece, pos = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(owner, kind="stable")
        return sym.astype(np.int32), np.bincount(word, minlength=len(texts)), _message(piece[order], pos[order]), np.bincount(owner, minlength=len(texts))


class Runs:
    """Rows of numbers of any length, behind one another; row 0 is empty."""

    def __init__(self, kind):
        self.flat, self.ends = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64)
        self.rows = 1

    def extend(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        first, rows = int(self.ends[self.rows - 1]), self.rows + len(sizes)
        for name, need in (("flat", first + len(flat)), ("ends", rows)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(len(old) // 2, need - len(old)), old.dtype)]))
        self.flat[first : first + len(flat)] = flat
        self.ends[self.rows : rows] = first + np.cumsum(sizes)
        self.rows = rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the rows, their sizes)"""
        first = self.ends[np.maximum(rows, 1) - 1]
        sizes = self.ends[rows] - first
        return self.flat[_spread(first, sizes)], sizes


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] numbers), first[1], ..."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


class Words:
    """Cut-outs by what no dropout key changes: their ids without dropout and the merges behind them. They lack the
    blank before a word. key: of texts that come without keys of their own, None for no dropout."""

    def __init__(self, batch: Batch, key: int | None, dropout: float, room: int = CACHE):
        self.batch, self.key, self.rate, self.room = batch, key, int(dropout * 2.0**64), room
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.merges = Runs(np.int32), Runs(np.uint64)

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words.difference(self.at) if len(w) <= LONG]
        if len(self.at) + len(new) > self.room:
            self._clear()
            new = [w for w in words if len(w) <= LONG]
        ids, sizes, merges, made = self.batch.encode(list(map(_whole, new)), None, 0)
        self.at.update(zip(new, range(self.ids.rows, self.ids.rows + len(new))))
        self.ids.extend(ids, sizes)
        self.merges.extend(merges, made)

    def encode(self, texts: list[str], keys: np.ndarray | None = None) -> list[np.ndarray]:
        """Ids of each text. keys: of the texts' documents; each occurrence of a cut-out then has its own key."""
        cuts = [_cut(t) for t in texts]
        self._learn(set().union(*cuts))
        flat = [w for c in cuts for w in c]
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        if keys is not None:
            own = occurrence_keys(np.repeat(keys, counts), _spread(np.zeros(len(cuts), np.int64), counts))
        else:
            own = None if self.key is None else np.full(len(flat), self.key, np.uint64)
        rows = np.fromiter(map(self.at.get, flat, repeat(0)), np.int64, len(flat))  # long ones are in row 0
        parts = []
        if own is not None:
            messages, made = self.merges.take(rows)
            skipped = _hashed(messages, np.repeat(own, made)) < np.uint64(self.rate)
            anew = np.unique(np.repeat(np.arange(len(flat)), made)[skipped])
            rows[anew] = 0
            ids, sizes, _, _ = self.batch.encode([_whole(flat[i]) for i in anew.tolist()], own[anew], self.rate)
            parts.append((anew, ids, sizes))
        for i, w in enumerate(flat):
            if len(w) > LONG:
                symbols = [SPACE if c == " " else None if c == SPACE else c for c in _whole(w)]
                ids = np.array(self.batch.codec.pieces(symbols, None if own is None else int(own[i]), self.rate), np.int32)
                parts.append((np.array([i]), ids, np.array([len(ids)])))
        ids, sizes = self.ids.take(rows)
        kept = np.flatnonzero(rows)
        parts.append((kept, ids, sizes[kept]))
        for at, _, n in parts:
            sizes[at] = n
        ends = np.cumsum(sizes)
        out = np.empty(int(sizes.sum()), np.int32)
        for at, ids, n in parts:
            out[_spread(ends[at] - n, n)] = ids
        bounds = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]


def _whole(cut: str) -> str:
    return cut if cut[:1] == "\n" else " " + cut


def _cut(text: str) -> list[str]:
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [c if c[0] == "\n" else c[1:] for c in _CUT.findall(" " + text)]
    return text.replace("\n", " \n").split(" ") if text[0] != "\n" else (" " + text).replace("\n", " \n")[1:].split(" ")


def dropout_key(seed: int, variant: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{variant}".encode())


def model_path(path: str | None = None) -> str:
    return path or os.path.join(TOKENIZERS, MODEL)


def variant_of(id_col: str, seed: int = SEED):
    """The document's variant, which is its dropout key: a keyed hash of its id."""
    return F.xxhash64(F.col(id_col), F.lit(seed))


class Encoder:
    """Texts of Arrow batches to ids, GROUP texts at a time; made once a task."""

    def __init__(self, path: str | None, dropout: float):
        self.words = Words(Batch(Codec(model_path(path))), None, dropout)
        self.codec, self.dropout = self.words.batch.codec, dropout

    def of(self, batch: pa.RecordBatch, at: int) -> tuple[list[str | None], list[np.ndarray | None]]:
        """(texts in column number `at`, their ids); the last column holds the variants."""
        texts = batch.column(at).to_pylist()
        rows = [i for i, t in enumerate(texts) if t is not None]
        keys = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)[rows] if self.dropout else None
        found: list = [None] * batch.num_rows
        for i, ids in zip(rows, self.words.encode([texts[i] for i in rows], keys)):
            found[i] = ids
        return texts, found


def _groups(batches):
    for whole in batches:
        for first in range(0, whole.num_rows, GROUP):
            yield whole.slice(first, GROUP)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """df with columns variant (bigint) and ids (array<int>)."""
    df = df.drop("variant", "ids")
    names = [*df.columns, "variant", "ids"]
    at = df.columns.index(text_col)

    def run(batches):
        encoder = Encoder(path, dropout)
        for batch in _groups(batches):
            _, found = encoder.of(batch, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=names)

    with_variant = df.withColumn("variant", variant_of(id_col, seed))
    return with_variant.mapInArrow(run, T.StructType([*with_variant.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df with column decoded, the text of column ids."""
    path, df = model_path(path), df.drop("decoded")
    names = [*df.columns, "decoded"]
    at = df.columns.index("ids")

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            # Numbers become Python objects a row at a time: a whole batch of them would take hundreds of MB.
            found = [codec.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


DIGEST = "n_pieces bigint, ids_hash string, text_crc32 bigint, lossless boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs without the text, with variant, number of pieces, hash of the ids, CRC of the decoded text, and whether it
    is the text. Ids are decoded where they are made, so neither they nor the texts leave the worker."""
    fields = [x.split(" ")[0] for x in DIGEST.split(", ")]
    others = [c for c in docs.columns if c not in (text_col, "variant", *fields)]

    def run(batches):
        encoder = Encoder(path, dropout)
        for batch in _groups(batches):
            texts, found = encoder.of(batch, 0)
            out = []
            for text, ids in zip(texts, found):
                back = None if ids is None else encoder.codec.decode(ids.tolist())
                out.append((None, None, None, text is None) if ids is None else (len(ids), xxhash.xxh64_hexdigest(ids.tobytes()), zlib.crc32(back.encode()), back == text))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*others, "variant", *fields])

    rows = docs.select(F.col(text_col).cast("string"), *others).withColumn("variant", variant_of(id_col, seed))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], *T.StructType.fromDDL(DIGEST).fields]))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded with dropout and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
