"""Byte-pair-encoding vocabularies compiled to deterministic automata.

Two machines are compiled from a tokenizer file:

* ``Splitter`` — a small deterministic transducer over character classes that marks where the
  pre-tokenizer starts a new piece. Its transition monoid is finite and tiny, so the state map of any
  chunk of text is one small integer, and chunks compose by table lookup in a parallel prefix scan.
* ``Automaton`` — for byte pair encodings whose ids follow merge order, the encoding of a prefix is
  the encoding of a shorter prefix plus one token, and exactly one vocabulary entry that ends there is
  compatible with the token before it. Reading one byte therefore moves a deterministic machine from
  one last token to another and changes the number of emitted tokens by a fixed amount.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from . import textscan as ts

U64 = np.uint64
LONG = 64
NONE = -1


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Splitter:
    """The two pre-tokenizer patterns used here: ``spaced`` (a space joins the piece that follows it, other white
    space makes pieces) and not (white space is dropped, each number character is a piece)."""

    # Symbols. The last of a run of white space before something else, and white space inside or at the end of a text, are told apart
    L, N, O, SPL, WSL, WSM, A1, A2, FIRST = 0, 1, 2, 3, 4, 5, 6, 7, 8
    START, IN_L, IN_N, IN_O, IN_S, SP, C1, C2 = range(8)

    def __init__(self, spaced: bool) -> None:
        self.spaced = spaced
        go, emit = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
        stay = {self.IN_L: (self.L,), self.IN_O: (self.O, self.A1, self.A2)}
        if spaced:
            stay[self.IN_N] = (self.N,)
        fresh = {self.L: self.IN_L, self.N: self.IN_N, self.O: self.IN_O, self.SPL: self.SP, self.WSL: self.START, self.WSM: self.IN_S, self.A1: self.C1, self.A2: self.C2}
        for s in range(8):
            for x in range(8):
                to, out = fresh[x], True
                if s == self.C1:
                    to, out = self.START, False
                elif s == self.C2:
                    to, out = self.C1, False
                elif x in stay.get(s, ()):
                    to, out = s, False
                elif spaced and s == self.IN_S and x == self.WSM:
                    out = False
                elif spaced and s == self.SP and x in (self.L, self.N, self.O, self.A1, self.A2):
                    to, out = {self.L: self.IN_L, self.N: self.IN_N}.get(x, self.IN_O), False
                if not spaced and x in (self.SPL, self.WSL, self.WSM) and s not in (self.C1, self.C2):
                    to, out = self.START, False
                go[s, x], emit[s, x] = to, out
        self.go, self.emit = go, emit
        # The monoid of state maps: symbols 0-7 as they are; 8-15 first reset to START, as at the head of a text.
        maps = [tuple(int(go[s, x]) for s in range(8)) for x in range(8)]
        maps += [(m[self.START],) * 8 for m in maps]
        ids = {tuple(range(8)): 0}
        for m in maps:
            ids.setdefault(m, len(ids))
        self.symbol = np.array([ids[m] for m in maps], np.uint16)
        todo, known = list(ids), list(ids)
        while todo:
            m = todo.pop()
            for x in maps:
                c = tuple(x[s] for s in m)
                if c not in ids:
                    ids[c] = len(ids)
                    known.append(c)
                    todo.append(c)
        self.table = np.array(known, np.uint8)
        n = len(known)
        self.mul = np.zeros((n, n), np.uint16)
        for i, m in enumerate(known):
            for j, x in enumerate(known):
                c = tuple(x[s] for s in m)
                if c not in ids:
                    raise AssertionError("the monoid is not closed")
                self.mul[i, j] = ids[c]

    def symbols(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Each character's class with what the pattern must know of those that follow; 8 is added at the head of a text."""
        n = len(cp)
        kind = ts.char_classes()[cp]
        sym = kind.copy()
        tails = off[1:][np.diff(off) > 0] - 1
        heads = off[:-1][np.diff(off) > 0]
        space = kind == ts.SPACE
        then = np.empty(n, bool)  # is more white space, or the end
        then[:-1] = space[1:]
        then[tails] = True
        at = np.flatnonzero(space)
        sym[at] = np.where(then[at], self.WSM, np.where(cp[at] == 32, self.SPL, self.WSL))
        quote = np.flatnonzero(cp == 39)
        if len(quote):
            left = off[np.searchsorted(off, quote, "right")] - quote  # characters to the end of the text
            a = np.where(left > 1, cp[np.minimum(quote + 1, n - 1)], 0)
            b = np.where(left > 2, cp[np.minimum(quote + 2, n - 1)], 0)
            one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            sym[quote] = np.where(one, self.A1, np.where(two, self.A2, self.O))
        sym[heads] += 8
        return sym

    def starts(self, cp: np.ndarray, off: np.ndarray, width: int = 64) -> np.ndarray:
        """Where pieces start. Chunks of ``width`` characters are mapped on their own; their maps are then composed."""
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64)
        sym = self.symbols(cp, off)
        rows = -(-n // width)
        maps = np.zeros(rows * width, np.uint16)
        maps[:n] = self.symbol[sym]
        maps = maps.reshape(rows, width).T.copy()
        size = np.uint16(len(self.table))
        flat = self.mul.ravel()
        for j in range(1, width):
            maps[j] = flat[maps[j - 1].astype(np.int32) * int(size) + maps[j]]
        total, step = maps[-1].copy(), 1
        while step < rows:  # inclusive scan by doubling
            total[step:] = flat[total[:-step].astype(np.int32) * int(size) + total[step:]]
            step *= 2
        state = np.empty((width, rows), np.uint8)  # before each character
        enter = np.zeros(rows, np.uint8)
        enter[1:] = self.table[total[:-1], self.START]
        state[0] = enter
        state[1:] = self.table[maps[:-1], enter[None, :]]
        state = state.T.ravel()[:n]
        head = sym >= 8
        state[head] = self.START
        emit = self.emit.ravel()[state.astype(np.int32) * 8 + (sym & 7)]
        return np.flatnonzero(emit)


class Automaton:
    """Counts (and ids) of the tokens of pieces given as symbols. A symbol is a byte, plus 256 for the last of a piece if
    the vocabulary marks ends of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, letters, vocab = model["end_of_word_suffix"] or "", byte_letters(), model["vocab"]

        def spell(token: str) -> tuple[int, ...]:
            end = bool(suffix) and token.endswith(suffix)
            out = [letters[c] for c in (token[: -len(suffix)] if end else token)]
            return (*out[:-1], out[-1] + 256) if end else tuple(out)

        self.ends = bool(suffix)
        size = max(vocab.values()) + 1
        spelled = {spell(t): i for t, i in vocab.items()}
        left, right = np.full(size, NONE, np.int32), np.full(size, NONE, np.int32)
        order, pair_keys, pair_ids = {}, [], []
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            if a + b in vocab:
                i, x, y = vocab[a + b], vocab[a], vocab[b]
                if i not in order:
                    order[i] = k
                    left[i], right[i] = x, y
                    pair_keys.append((x << 20) | y)
                    pair_ids.append(i)
        base = [i for i in range(size) if i not in order]
        if sorted(order, key=order.get) != sorted(order) or (base and order and max(base) > min(order)):
            raise ValueError("this vocabulary's ids do not follow the order of its merges")
        self.left, self.right = left, right
        for i in base:
            left[i] = right[i] = i
        self.pairs = ts.Table(18)
        self.pairs.add(np.array(pair_keys, U64) + U64(1), np.array(pair_ids, np.int32))
        # The trie: children by (node, symbol); root children in a dense row.
        nodes: dict[tuple[int, ...], int] = {(): 0}
        child_keys, child_ids, token_at = [], [], [NONE]
        self.longest = 1
        for s, i in spelled.items():
            self.longest = max(self.longest, len(s))
            for k in range(1, len(s) + 1):
                if s[:k] not in nodes:
                    nodes[s[:k]] = len(nodes)
                    child_keys.append((nodes[s[: k - 1]] << 9) | s[k - 1])
                    child_ids.append(nodes[s[:k]])
                    token_at.append(NONE)
            token_at[nodes[s]] = i
        self.token_at = np.array(token_at, np.int32)
        self.children = ts.Table(18)
        self.children.add(np.array(child_keys, U64) + U64(1), np.array(child_ids, np.int32))
        self.root = np.zeros(512, np.int32)
        for k, i in zip(child_keys, child_ids):
            if k >> 9 == 0:
                self.root[k & 511] = i
        self.memo_key, self.memo_val = np.zeros(1 << 20, U64), np.zeros(1 << 20, bool)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of a's and b's text is a, b. Undoes merges from the seam outwards, as long as an earlier
        merge across the seam could have come first."""
        key = (a.astype(U64) << U64(20)) | b.astype(U64)
        key += U64(1)
        slot = ((key * U64(0x9E3779B97F4A7C15)) >> U64(44)).astype(np.int64)
        out = self.memo_val[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            got = self._compatible(a[miss].astype(np.int64), b[miss].astype(np.int64))
            out[miss] = got
            self.memo_key[slot[miss]], self.memo_val[slot[miss]] = key[miss], got
            out[miss] = got
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good, lane = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 30, np.int64)
        while len(lane):
            c = self.pairs.find(((a.astype(U64) << U64(20)) | b.astype(U64)) + U64(1))
            bad = (c >= 0) & (c < limit)
            good[lane[bad]] = False
            keep = ~bad
            lane, a, b, limit = lane[keep], a[keep], b[keep], limit[keep]
            first = a > b
            # The later of the two merges is undone; if that side is a single symbol, the other.
            na, nlimit, nb, blimit = self.right[a], a.copy(), self.left[b], b + 1
            stuck_a, stuck_b = na == a, nb == b
            use_a = np.where(first, ~stuck_a, stuck_b & ~stuck_a)
            use_b = np.where(first, stuck_a & ~stuck_b, ~stuck_b)
            done = ~use_a & ~use_b
            limit = np.where(use_a, nlimit, blimit)
            a, b = np.where(use_a, na, a), np.where(use_b, nb, b)
            keep = ~done
            lane, a, b, limit = lane[keep], a[keep], b[keep], limit[keep]
        return good

    def counts(self, flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Token counts of the pieces flat[off[i]:off[i+1]] (bytes)."""
        return self._run(flat, off, None)

    def ids(self, flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' token ids, one piece after the other, and the pieces' counts."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        counts = self._run(flat, off, found)
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int32)
        for which, tokens in found:
            n = counts[which]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(first[which], n) + k] = tokens
        return out, counts

    def _run(self, flat: np.ndarray, off: np.ndarray, found: list | None) -> np.ndarray:
        counts = np.zeros(len(off) - 1, np.int32)
        size = np.diff(off)
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 16), (17, 24), (25, LONG)):
            which = np.flatnonzero((size >= lo) & (size <= hi))
            for part in np.array_split(which, max(1, -(-len(which) * hi * hi // 4_000_000))):
                if len(part):
                    counts[part], tokens = self._dense(flat, off[part], size[part], found is not None)
                    if found is not None:
                        found.append((part, tokens))
        for i in np.flatnonzero(size > LONG):
            tokens = self._single(flat[off[i] : off[i + 1]])
            counts[i] = len(tokens)
            if found is not None:
                found.append((np.array([i]), np.array(tokens, np.int32)))
        return counts

    def _dense(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        n, width = len(start), int(size.max())
        most = min(width, self.longest)
        cand = np.full((width + 1, most + 1, n), NONE, np.int32)  # by end, length and piece
        word = np.repeat(np.arange(n), size)
        begin = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        sym = flat[np.repeat(start, size) + begin].astype(np.int64)
        left = np.repeat(size, size) - begin
        if self.ends:
            sym[left == 1] += 256
        node, at = self.root[sym], np.arange(len(word))
        for k in range(1, most + 1):
            live = node > 0
            node, at = node[live], at[live]
            token = self.token_at[node]
            has = token >= 0
            h = at[has]
            cand[begin[h] + k, k, word[h]] = token[has]
            more = left[at] > k
            node, at = node[more], at[more]
            if not len(at):
                break
            node = self.children.find(((node.astype(U64) << U64(9)) | sym[at + k].astype(U64)) + U64(1))
        last = np.full((width + 1, n), NONE, np.int32)
        count, back = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        for i in range(1, width + 1):
            open_ = np.flatnonzero(size >= i)
            for k in range(min(i, most), 0, -1):
                c = cand[i, k, open_]
                lane = np.flatnonzero(c >= 0)
                if len(lane):
                    w, c = open_[lane], c[lane]
                    if k < i:
                        before = last[i - k, w]
                        ok = (before >= 0) & self.compatible(np.maximum(before, 0), c)
                        lane, w, c = lane[ok], w[ok], c[ok]
                    last[i, w], count[i, w], back[i, w] = c, count[i - k, w] + 1, k
                    open_ = np.delete(open_, lane)
                    if not len(open_):
                        break
        total = count[size, np.arange(n)]
        if not ids:
            return total, None
        out = np.zeros(int(total.sum()), np.int32)
        lane, at, end = np.arange(n), size.copy(), np.cumsum(total)
        while len(lane):
            end[lane] -= 1
            out[end[lane]] = last[at[lane], lane]
            at[lane] -= back[at[lane], lane]
            lane = lane[at[lane] > 0]
        return total, out

    def _single(self, piece: np.ndarray) -> list[int]:
        """The same machine on one long piece: its token ids."""
        n = len(piece)
        sym = piece.astype(np.int64)
        if self.ends:
            sym[-1] += 256
        ending: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        node, at = self.root[sym], np.arange(n)
        for k in range(1, min(n, self.longest) + 1):
            live = node > 0
            node, at = node[live], at[live]
            token = self.token_at[node]
            for p, t in zip((at[token >= 0] + k).tolist(), token[token >= 0].tolist()):
                ending[p].append((k, t))
            more = at + k < n
            node, at = node[more], at[more]
            if not len(at):
                break
            node = self.children.find(((node.astype(U64) << U64(9)) | sym[at + k].astype(U64)) + U64(1))
        last, back, seen = [NONE] * (n + 1), [0] * (n + 1), {}
        for i in range(1, n + 1):
            for k, t in reversed(ending[i]):
                if k < i:
                    key = (last[i - k], t)
                    if key[0] < 0:
                        continue
                    if key not in seen:
                        seen[key] = bool(self._compatible(np.array([key[0]]), np.array([t]))[0])
                    if not seen[key]:
                        continue
                last[i], back[i] = t, k
                break
        out, i = [], n
        while i:
            out.append(last[i])
            i -= back[i]
        return out[::-1]
