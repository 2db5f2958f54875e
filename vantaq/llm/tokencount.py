"""Token counts by a finite-state tokenizer.

The tokenizer file is compiled once per worker (``bpe.Splitter`` and ``bpe.Automaton``). The splitter's
state maps of fixed-width chunks are composed by a parallel prefix scan, which gives every character
the state before it; the transitions into new pieces are marked. Pieces go through the byte automaton,
whose transitions carry emitted-token counts; the total of a piece, seen before, is kept by its hash,
so that frequent pieces run through the machine once per worker. Chunks are composed for the splitter alone: a piece is short, so its bytes run through one lane.

Cases: a null or empty text has 0 bytes and 0 tokens; text equal to a special token of the tokenizer's file counts as one
token, as the library has it by default; texts of any length are handled whole; repeated rows are counted each, rows without doc_id
too, no ties arise; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import textscan as ts
from .base import per_batch

#: Pieces kept per worker before the table starts afresh.
KNOWN_PIECES = 800_000


class Counter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            added = json.load(f).get("added_tokens") or []
        odd = [t["content"] for t in added if any(t.get(k) for k in ("normalized", "single_word", "lstrip", "rstrip"))]
        if odd:
            raise ValueError(f"special tokens with conditions on what stands around them: {odd}")
        # Longer ones first, as the library prefers them where several begin.
        self.special = sorted((t["content"] for t in added), key=lambda x: (-len(x), x))
        self.machine, self.splitter = bpe.Automaton(path), bpe.Splitter(spaced=True)
        self.known = ts.Table(16)

    def texts(self, values: pa.Array) -> np.ndarray:
        values = values.fill_null("")
        out = np.zeros(len(values), np.int64)
        plain, odd = values, np.zeros(len(values), bool)
        for s in self.special:
            odd |= np.asarray(pa.compute.match_substring(values, s))
        if odd.any():
            plain = pa.compute.if_else(pa.array(~odd), values, "")
            owner, parts = [], []
            for i in np.flatnonzero(odd).tolist():
                pieces = [values[i].as_py()]
                for s in self.special:
                    pieces = [y for x in pieces for y in x.split(s)]
                out[i] = len(pieces) - 1
                owner += [i] * len(pieces)
                parts += pieces
            np.add.at(out, np.array(owner), self.texts_plain(pa.array(parts, pa.string())))
        return out + self.texts_plain(plain)

    def texts_plain(self, values: pa.Array) -> np.ndarray:
        return np.concatenate([self._block(b) for b in ts.blocks(values)] or [np.zeros(0, np.int64)])

    def _block(self, block: ts.Block) -> np.ndarray:
        cp, at, off = block.chars()
        start = self.splitter.starts(cp, off)
        if not len(start):
            return np.zeros(block.n, np.int64)
        end = np.append(start[1:], len(cp))
        h = ts.Rolling(ts.codes_of(cp)).of(start, end)
        counts = self.known.find(h)
        new = np.flatnonzero(counts < 0)
        if len(new):
            keys, one = ts.distinct(h[new])
            one = new[one]
            at_end = np.append(at, len(block.buf))
            lo, hi = at_end[start[one]], at_end[end[one]]
            size = hi - lo
            flat_off = np.zeros(len(one) + 1, np.int64)
            np.cumsum(size, out=flat_off[1:])
            flat = block.buf[np.repeat(lo - flat_off[:-1], size) + np.arange(flat_off[-1])]
            if self.known.n + len(keys) > KNOWN_PIECES:
                self.known = ts.Table(16)
            fresh = self.machine.counts(flat, flat_off)
            self.known.add(keys, fresh)
            counts[new] = fresh[np.searchsorted(keys, h[new])]
        return ts.sums_by(counts, np.searchsorted(start, off))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of ``docs``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1)
        n = counter(tokenizer).texts(texts)
        size = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(count), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
