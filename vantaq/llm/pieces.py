"""SentencePiece encoding and decoding of whole texts, for merge-type models, by backtracking.

A model's merges depend on neighbours only through what its pieces hold, so a text is cut for certain wherever no piece has the
two characters side by side; what lies between two cuts (a stretch, mostly a word with the space before it) is encoded once per
worker and then kept. A new stretch is encoded as follows, many stretches in step as lanes of numpy arrays:

* An Aho-Corasick automaton of the reversed pieces reads each stretch from its end; its output at a character is the longest
  piece that starts there. Shorter ones follow from a table of each piece's longest prefix that is a piece.
* From the left, the longest piece is taken if it is compatible with the piece before it: if merging both pieces' characters
  anew would give these two pieces again (``compatible``, which undoes merges from the seam outwards).
* Where none fits, the place is marked in a bitfield of failed places and the piece before it is taken back. The pieces of
  a prefix are unique, so a place that failed once fails always, and every place is entered at most once for each piece.

Decoding is a gather of the pieces' bytes.

Cases: a null or empty text has no pieces between begin and end and decodes to an empty text; texts of any length are handled whole;
repeated rows and rows without doc_id are encoded each; ties between equal scores go to the left; other columns,
whatever their names, are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .base import per_batch

U64 = np.uint64
NONE = -1
SPACE = 0x2581
#: Distinct stretches kept per worker before the table starts afresh.
KNOWN_STRETCHES = 800_000
#: Bits of the filter of neighbouring characters; a false hit costs a cut, never a result.
NEIGHBOUR_BITS = 22


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[i] & 127) << shift
            shift += 7
            i += 1
            if message[i - 1] < 128:
                return value, i

    i = 0
    while i < len(message):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = varint(i)
            value, i = message[i : i + size], i + size
        yield key >> 3, value


class Kept:
    """Sequences of ids by the hash of what they encode. The first sequence is empty."""

    def __init__(self) -> None:
        self.table, self.pool, self.used = ts.Table(16), np.zeros(1 << 16, np.int32), 0
        self.first, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 1

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + len(keys) > len(self.first):
            self.first, self.size = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[self.n : self.n + len(keys)] = self.used + np.cumsum(size) - size
        self.size[self.n : self.n + len(keys)] = size
        self.table.add(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.used += len(ids)
        self.n += len(keys)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences' ids one after the other, and where each sequence starts (one entry more)."""
        size = self.size[which]
        total = np.zeros(len(which) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        return self.pool[np.repeat(self.first[which] - total[:-1], size) + np.arange(total[-1])], total


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] of them, for each i."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Model:
    """A merge-type model with byte fallback. Ids of characters that are no piece follow the pieces'."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer, normalizer = {}, {}
        for number, value in fields(library.serialized_model_proto()):
            if number in (2, 3):
                (trainer if number == 2 else normalizer).update(fields(value))
        wrong = {
            "is not of the merge type": trainer.get(3) != 2,
            "has no byte fallback": not trainer.get(35),
            "has the space after words": bool(trainer.get(24)),
            "normalizes characters": bool(normalizer.get(2)),
            "removes white space": bool(normalizer.get(4, 1)),
            "leaves spaces as they are": not normalizer.get(5, 1),
        }
        if any(wrong.values()):
            raise ValueError("this model " + ", ".join(k for k, v in wrong.items() if v))
        self.prefixed = bool(normalizer.get(3, 1))
        n = library.get_piece_size()
        self.begin, self.end, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        self.library, self.n = library, n
        self.byte_of, self.control = np.full(n, NONE, np.int32), np.zeros(n, bool)
        names, score = {}, {}
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_of[i] = int(piece[1:-1], 16)
            elif library.is_control(i):
                self.control[i] = True
            elif library.is_unused(i):
                raise ValueError("this model has unused pieces")
            elif not library.is_unknown(i):
                names[piece], score[i] = i, library.get_score(i)
        self.byte_id = np.full(256, NONE, np.int32)
        at = np.flatnonzero(self.byte_of >= 0)
        self.byte_id[self.byte_of[at]] = at
        chars = sorted({c for p in names for c in p})
        self._compile(names, score, chars)
        self._spell(names)
        self.kept = Kept()

    def _compile(self, names: dict[str, int], score: dict[int, float], chars: list[str]) -> None:
        ids = dict(names)
        for c in chars:
            ids.setdefault(c, self.n + len(ids) - len(names))
        size = self.n + len(ids) - len(names)
        order = {s: k + 1 for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.zeros(size, np.int64)
        self.left, self.right = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32)
        self.length, self.shorter = np.ones(size, np.int32), np.full(size, NONE, np.int32)
        pair_keys, pair_ids = [], []
        for p, i in names.items():
            if len(p) > 1:
                self.rank[i], self.length[i] = order[score[i]], len(p)
                for k in range(1, len(p)):
                    if p[:k] in ids and p[k:] in ids:
                        pair_keys.append((ids[p[:k]] << 20) | ids[p[k:]])
                        pair_ids.append(i)
        # The pieces by length: a piece's own merges are those of its two parts, and one more.
        for p in sorted((p for p in names if len(p) > 1), key=len):
            parts = self._merged(p, names)
            if parts is None:
                raise ValueError(f"the piece {p!r} is not made by merges")
            i, a, b = names[p], ids[parts[0]], ids[parts[1]]
            if max(self.rank[a], self.rank[b]) > self.rank[i]:
                raise ValueError(f"the piece {p!r} is merged before its parts")
            self.left[i], self.right[i] = a, b
            self.shorter[i] = next(ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in ids)
        self.pairs = ts.Table(18)
        self.pairs.add(np.array(pair_keys, U64) + U64(1), np.array(pair_ids, np.int32))
        self.memo_key, self.memo_val = np.zeros(1 << 20, U64), np.zeros(1 << 20, bool)
        self.char_id = np.full(0x110000, NONE, np.int32)
        self.char_id[[ord(c) for c in chars]] = [ids[c] for c in chars]
        self.filter = np.zeros(1 << NEIGHBOUR_BITS, bool)
        near = np.array(sorted({(ord(a), ord(b)) for p in names for a, b in zip(p, p[1:])}), U64).reshape(-1, 2)
        self.filter[self._slot(near[:, 0], near[:, 1])] = True
        # The automaton of the reversed pieces: nodes in breadth-first order, so a node's fallback is known before its children's.
        nodes: dict[tuple[int, str], int] = {}
        where, out, fail = {"": 0}, [NONE], [0]
        frontier = [""]
        ends = {p[::-1]: i for p, i in ids.items()}
        below: dict[str, set[str]] = {}
        for p in ends:
            for k in range(len(p)):
                below.setdefault(p[:k], set()).add(p[k])
        while frontier:
            after = []
            for s in frontier:
                for c in sorted(below.get(s, ())):
                    node = len(out)
                    where[s + c] = nodes[where[s], c] = node
                    back = fail[where[s]] if s else 0
                    while s and back and (back, c) not in nodes:
                        back = fail[back]
                    fail.append(nodes.get((back, c), 0) if s else 0)
                    out.append(ends.get(s + c, out[fail[node]]))
                    after.append(s + c)
            frontier = after
        self.fail, self.out = np.array(fail, np.int32), np.array(out, np.int32)
        self.go = ts.Table(18)
        self.go.add(np.array([(a << 21) | ord(c) for a, c in nodes], U64) + U64(1), np.array(list(nodes.values()), np.int32))

    def _merged(self, piece: str, names: dict[str, int]) -> tuple[str, str] | None:
        """The parts of the last merge when a piece's characters are merged; None if they don't become the piece."""
        parts, last = list(piece), None
        while len(parts) > 1:
            found = [(self.rank[names[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in names]
            if not found:
                return None
            k = min(found)[1]
            last = parts[k], parts[k + 1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def _spell(self, names: dict[str, int]) -> None:
        """The bytes that ids decode to, one after the other."""
        spelled = [b""] * self.n
        for p, i in names.items():
            spelled[i] = p.replace(chr(SPACE), " ").encode("utf-8")
        for i in np.flatnonzero(self.byte_of >= 0).tolist():
            spelled[i] = bytes([int(self.byte_of[i])])
        spelled[self.unknown] = self.library.decode([self.unknown]).encode("utf-8")
        self.spelled_size = np.array([len(x) for x in spelled], np.int64)
        self.spelled_first = np.cumsum(self.spelled_size) - self.spelled_size
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spaced = np.zeros(self.n, bool)
        self.spaced[[i for p, i in names.items() if p[0] == chr(SPACE)]] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (((a.astype(U64) << U64(21)) | b.astype(U64)) * U64(0x9E3779B97F4A7C15) >> U64(64 - NEIGHBOUR_BITS)).astype(np.int64)

    # Compatibility

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a and b anew gives a, b."""
        key = ((a.astype(U64) << U64(20)) | b.astype(U64)) + U64(1)
        slot = ((key * U64(0x9E3779B97F4A7C15)) >> U64(44)).astype(np.int64)
        out = self.memo_val[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            got = self.remerged(a[miss].astype(np.int64), b[miss].astype(np.int64))
            self.memo_key[slot[miss]], self.memo_val[slot[miss]] = key[miss], got
            out[miss] = got
        return out

    def remerged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible``, worked out. Of the two pieces at the seam the one that was merged later is undone, until a merge across the
        seam would have come before what was undone last (then they are not compatible), or single characters are left.
        Times are twice the rank, and one more on the right side, since of merges of one rank the left comes first."""
        good, lane = np.ones(len(a), bool), np.arange(len(a))
        since = np.full(len(a), 1 << 60, np.int64)
        while len(lane):
            across = self.pairs.find(((a.astype(U64) << U64(20)) | b.astype(U64)) + U64(1))
            bad = (across >= 0) & (2 * self.rank[across] < since)
            good[lane[bad]] = False
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            on = ~bad & ~(whole_a & whole_b)
            undo_a = ~whole_a & (whole_b | (self.rank[a] > self.rank[b]))
            since = np.where(undo_a, 2 * self.rank[a], 2 * self.rank[b] + 1)[on]
            a, b = np.where(undo_a, self.right[a], a)[on].astype(np.int64), np.where(undo_a, b, self.left[b])[on].astype(np.int64)
            lane = lane[on]
        return good

    # Encoding

    def longest(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each character of the stretches, which are in order of falling size, the longest piece that starts there."""
        out = np.full(len(cp), NONE, np.int32)
        state = np.zeros(len(start), np.int64)
        for k in range(1, int(size.max(initial=0)) + 1):
            m = int(np.searchsorted(-size, -k, "right"))  # stretches of k characters at least
            at = start[:m] + size[:m] - k
            c, here = cp[at].astype(U64), state[:m]
            left = np.arange(m)
            to = np.zeros(m, np.int64)
            while len(left):
                found = self.go.find(((here[left].astype(U64) << U64(21)) | c[left]) + U64(1))
                hit = found >= 0
                to[left[hit]] = found[hit]
                left = left[~hit & (here[left] > 0)]
                here[left] = self.fail[here[left]]
            state[:m] = to
            out[at] = self.out[to]
        return out

    def stretches(self, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece ids of stretches of known characters, one stretch after the other, and how many each has."""
        n = len(start)
        order = np.argsort(-size, kind="stable")
        size_, start_ = size[order], start[order]
        longest = self.longest(cp, start_, size_)
        taken = np.zeros(len(cp), np.int32)
        words = (size_ + 64) >> 6  # of the bitfield: a bit for each place from 0 to the stretch's end
        base = np.cumsum(words) - words
        failed = np.zeros(int(words.sum()), U64)
        place, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lane, cand = np.arange(n), longest[start_]
        while len(lane):
            none = cand < 0
            piece = np.maximum(cand, 0)
            end = place[lane] + self.length[piece]
            ok = ~none & ((failed[base[lane] + (end >> 6)] >> (end & 63).astype(U64)) & U64(1) == 0)
            check = np.flatnonzero(ok & (depth[lane] > 0))
            who = lane[check]
            ok[check] = self.compatible(taken[start_[who] + depth[who] - 1], piece[check])
            # Taken
            who, what = lane[ok], piece[ok]
            taken[start_[who] + depth[who]] = what
            depth[who] += 1
            place[who] = end[ok]
            more = place[who] < size_[who]
            after = np.full(len(lane), NONE, np.int32)
            after[np.flatnonzero(ok)[more]] = longest[start_[who[more]] + place[who[more]]]
            over = np.zeros(len(lane), bool)
            over[np.flatnonzero(ok)[~more]] = True
            # Refused: a shorter piece
            refused = ~ok & ~none
            after[refused] = self.shorter[piece[refused]]
            # No shorter one: the place fails, and the piece before it is taken back
            back = np.flatnonzero(none)
            who = lane[back]
            if len(who):
                np.bitwise_or.at(failed, base[who] + (place[who] >> 6), U64(1) << (place[who] & 63).astype(U64))
                depth[who] -= 1
                if (depth[who] < 0).any():
                    raise AssertionError("a stretch without an encoding")
                what = taken[start_[who] + depth[who]]
                place[who] -= self.length[what]
                after[back] = self.shorter[what]
            cand, lane = after[~over], lane[~over]
        counts = np.zeros(n, np.int64)
        counts[order] = depth
        return taken[spread(start, counts)], counts

    def _learn(self, keys: np.ndarray, cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        first = np.cumsum(size) - size
        chars = cp[spread(start, size)]
        known = self.char_id[chars[first]] >= 0  # a stretch has more than one character only if all are in pieces
        ids, counts = np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        if known.any():
            ids, counts[known] = self.stretches(chars, first[known], size[known])
        if not known.all() or (ids >= self.n).any():
            # Characters that are no piece become bytes.
            out = []
            at = np.cumsum(counts) - counts
            for i, k, n in zip(range(len(start)), at.tolist(), counts.tolist()):
                got = []
                spelled = [chr(chars[first[i]])] if not known[i] else None
                for t in [NONE] if spelled else ids[k : k + n].tolist():
                    if t < 0 or t >= self.n:
                        c = spelled[0] if spelled else chr(int(np.flatnonzero(self.char_id == t)[0]))
                        got += self.byte_id[list(c.encode("utf-8"))].tolist()
                    else:
                        got.append(t)
                out += got
                counts[i] = len(got)
            ids = np.array(out, np.int32)
        self.kept.add(keys, ids, counts)

    def block(self, block: ts.Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts without begin and end, and where each text's start (one entry more)."""
        cp, _, off = block.chars()
        cp = np.where(cp == 32, np.uint32(SPACE), cp)
        if self.prefixed:
            full = np.diff(off) > 0
            cp = np.insert(cp, off[:-1][full], SPACE)
            off = off + np.concatenate([[0], np.cumsum(full)])
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(block.n + 1, np.int64)
        cut = np.ones(len(cp), bool)
        cut[1:] = ~self.filter[self._slot(cp[:-1], cp[1:])]
        odd = self.char_id[cp] < 0
        cut |= odd
        cut[1:] |= odd[:-1]
        cut[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(cp))
        h = ts.Rolling(ts.codes_of(cp)).of(start, end)
        which = self.kept.table.find(h)
        new = np.flatnonzero(which < 0)
        if len(new):
            if self.kept.n > KNOWN_STRETCHES:
                self.kept = Kept()
                new = np.arange(len(h))
            keys, one = ts.distinct(h[new])
            one = new[one]
            self._learn(keys, cp, start[one], end[one] - start[one])
            which[new] = self.kept.table.find(h[new])
        ids, total = self.kept.gather(which)
        return ids, total[np.searchsorted(start, off)]

    # Decoding

    def decoded(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts of the sequences ids[first[i]:first[i+1]] as bytes, and where each starts. ``ids`` may hold control ids."""
        text = ~self.control[ids]
        size = np.where(text, self.spelled_size[ids], 0)
        begin = self.spelled_first[ids]
        if self.prefixed:
            # The space that a text began with is not its own.
            kept = np.flatnonzero(text)
            head = np.searchsorted(kept, first[:-1])
            head = kept[head[(head < len(kept))]] if len(kept) else head[:0]
            head = np.unique(head)
            owner = np.searchsorted(first, head, "right") - 1
            seen = np.concatenate([[0], np.cumsum(text)])
            head = head[(seen[head] == seen[first[owner]]) & self.spaced[ids[head]]]
            size[head] -= 1
            begin[head] += 1
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        flat = self.spelled[spread(begin, size)]
        off = total[first]
        if (self.byte_of[ids] >= 0x80).any():
            shown = np.flatnonzero(text)
            parted = (np.diff(shown) > 1) & (self.byte_of[ids[shown[:-1]]] >= 0) & (self.byte_of[ids[shown[1:]]] >= 0)
            try:
                if not parted.any():
                    flat.tobytes().decode("utf-8")
                    return flat, off
            except UnicodeDecodeError:
                pass
            return self._mended(ids, first, flat, total)
        return flat, off

    def _mended(self, ids: np.ndarray, first: np.ndarray, flat: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of byte ids that are no text: every byte that begins no character becomes a replacement character."""
        out, off = [], [0]
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            text, run = bytearray(), bytearray()
            for k in range(i, j + 1):
                if k < j and self.byte_of[ids[k]] >= 0:
                    run.append(self.byte_of[ids[k]])
                    continue
                at = 0
                while at < len(run):
                    for n in (1, 2, 3, 4):
                        try:
                            text += run[at : at + n].decode("utf-8").encode("utf-8")
                            break
                        except UnicodeDecodeError:
                            pass
                    else:
                        n = 1
                        text += "�".encode()
                    at += min(n, len(run) - at)
                run.clear()
                if k < j:
                    text += flat[total[k] : total[k + 1]].tobytes()
            out.append(bytes(text))
            off.append(off[-1] + len(text))
        return np.frombuffer(b"".join(out), np.uint8), np.array(off, np.int64)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def _sequences(values: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in ts.blocks(values):
        ids, first = model(path).block(b)
        # An empty text's end stands before the next text's begin.
        n = len(first) - 1
        out = np.empty(len(ids) + 2 * n, np.int32)
        at = first + 2 * np.arange(n + 1)
        inner = np.ones(len(out), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        out[at[:-1]], out[at[1:] - 1], out[inner] = model(path).begin, model(path).end, ids
        yield out, at


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers, with begin and end) and decoded text for every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, texts, lengths = [], [], [], []
        for seq, first in _sequences(batch.column(1), path):
            flat, off = model(path).decoded(seq, first)
            ids.append(seq.astype("<u4"))
            texts.append(flat)
            sizes.append(np.diff(first))
            lengths.append(np.diff(off))
        size, length = np.concatenate(sizes or [np.zeros(0, np.int64)]), np.concatenate(lengths or [np.zeros(0, np.int64)])

        def column(kind: pa.DataType, data: list[np.ndarray], n: np.ndarray) -> pa.Array:
            off = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=off[1:])
            raw = np.concatenate(data).view(np.uint8) if data else np.zeros(0, np.uint8)
            wide = pa.large_binary() if kind == pa.binary() else pa.large_string()
            return pa.Array.from_buffers(wide, len(n), [None, pa.py_buffer(off), pa.py_buffer(raw)]).cast(kind)

        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), column(pa.binary(), ids, 4 * size), column(pa.string(), texts, length)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return _read(docs).mapInArrow(per_batch(run), "doc_id long, n_tokens long, ids binary, decoded string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (with begin and end) for every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(_sequences(batch.column(1), path))
        off = np.zeros(batch.num_rows + 1, np.int32)
        np.cumsum(np.concatenate([np.diff(f) for _, f in parts] or [np.zeros(0, np.int64)]), out=off[1:])
        ids = np.concatenate([s for s, _ in parts] or [np.zeros(0, np.int32)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], names=["doc_id", "ids"])

    return _read(docs).mapInArrow(per_batch(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text for every row of ``rows`` (doc_id, ids); ids that are null are none. An id that the model doesn't have ends the job."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for ids in batch.column(1):
            seq = np.array(ids.as_py() or [], np.int64)
            if len(seq) and not (0 <= seq.min() and seq.max() < model(path).n):
                raise ValueError("an id that the model doesn't have")
            texts.append(model(path).decoded(seq, np.array([0, len(seq)]))[0].tobytes().decode("utf-8"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(per_batch(run), "doc_id long, text string")


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
