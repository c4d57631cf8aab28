"""Chunking and token budgeting.

* ``chunk_chars``: fixed-width character pieces, narrow (no shuffle).
* ``pack_greedy``: the original greedy token packing with reset.  It is a
  sequential scan per document and runs as a grouped Arrow map per document.
* ``pack_prefix``: a window-sum packing (ours), a different rule under its own
  name that needs no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlake.functions.text import token_count


def chunk_chars(paras: DataFrame, size: int, drop_exact: bool = False,
                text_col: str = "text") -> DataFrame:
    """Split each paragraph into ``size``-character pieces.

    Pieces never cross paragraphs; empty paragraphs give no piece.  With
    ``drop_exact`` a final piece of exactly ``size`` characters is dropped, as
    the original loop (``while len > size`` ... ``if 0 < len < size``) does.
    """
    n = F.length(F.col(text_col))
    pieces = F.ceil(n / F.lit(size)).cast("int")
    if drop_exact:
        pieces = pieces - F.when(n % F.lit(size) == 0, 1).otherwise(0)
    # An empty array instead of a filter: a filter would be pushed below the
    # normalising projection and run its regex twice.
    idx = F.when(F.col("_pieces") > 0, F.sequence(F.lit(0), F.col("_pieces") - 1)) \
        .otherwise(F.array().cast("array<int>"))
    out = (paras.withColumn("_pieces", pieces)
           .withColumn("piece_idx", F.explode(idx))
           .withColumn(text_col, F.col(text_col).substr(F.col("piece_idx") * size + 1, F.lit(size)))
           .drop("_pieces"))
    return out


def with_token_counts(df: DataFrame, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    return df.withColumn(out, token_count(text_col))


def _greedy_pack_ids(n_tokens: np.ndarray, max_tokens: int, fill: int | None = None, pack: int = 0,
                     with_state: bool = False):
    """Pack number of each paragraph in order; a pack closes when the next one
    would overflow it (strict ``>``); an oversized paragraph is its own pack.

    ``fill`` is what the open pack ``pack`` holds already, ``None`` before the
    first paragraph.  One search per pack, not one step per paragraph.
    ``with_state`` returns the open pack and its fill as well.
    """
    t = np.asarray(n_tokens, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(t)])
    out = np.empty(len(t), dtype=np.int64)
    i, started, held = 0, fill is not None, int(fill or 0)
    while i < len(t):
        end = int(np.searchsorted(total, total[i] + max_tokens - held, side="right")) - 1
        if end > i:  # paragraphs i..end-1 still fit
            out[i:end], held, i = pack, held + int(total[end] - total[i]), end
        else:  # paragraph i opens a pack, whatever its size
            pack += started
            out[i], held, i = pack, int(t[i]), i + 1
        started = True
    return (out, pack, held if started else None) if with_state else out


def _stream_pack(paras: DataFrame, max_tokens: int, doc_key: str, order_col: str, tokens_col: str,
                 schema: T.StructType) -> DataFrame:
    """Greedy packing of whole documents streamed in (document, position)
    order with the state carried across Arrow batches (constant memory)."""
    slim = (paras.select(doc_key, order_col, tokens_col)
            .repartition(doc_key).sortWithinPartitions(doc_key, order_col))

    def pack(batches):
        doc, pack_no, fill = None, 0, None
        for pdf in batches:
            docs = pdf[doc_key].to_numpy()
            toks = pdf[tokens_col].to_numpy()
            ids = np.empty(len(pdf), dtype=np.int64)
            turns = [0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(pdf)]
            for lo, hi in zip(turns[:-1], turns[1:]):
                if lo == hi:
                    continue
                if docs[lo] != doc:
                    doc, pack_no, fill = docs[lo], 0, None
                ids[lo:hi], pack_no, fill = _greedy_pack_ids(toks[lo:hi], max_tokens, fill, pack_no, with_state=True)
            yield pdf.assign(pack_id=ids)

    return slim.mapInPandas(pack, schema=schema)


def _transfer(tokens: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy packing over a block for every possible entry state at once.

    States: ``0..max`` = fill of the open pack, ``max+1`` = overfull (any next
    paragraph opens a pack), ``max+2`` = document start (the first paragraph
    always joins pack 0).  Returns the exit state and the number of packs
    opened inside the block, per entry state.
    """
    cap, start = max_tokens + 1, max_tokens + 2
    state = np.arange(max_tokens + 3, dtype=np.int64)
    opened = np.zeros(len(state), dtype=np.int64)
    for i, t in enumerate(tokens.tolist()):
        if i % 64 == 0 and np.all(state == state[0]):
            # every entry state has merged: one scalar walk finishes the block
            s, extra = int(state[0]), 0
            for u in tokens[i:].tolist():
                if s != start and s + u > max_tokens:
                    extra, s = extra + 1, min(u, cap)
                else:
                    s = min(u, cap) if s == start else min(s + u, cap)
            return np.full(len(state), s), opened + extra
        is_start = state == start
        new = ~is_start & (state + t > max_tokens)
        opened += new
        state = np.where(new | is_start, min(t, cap), np.minimum(state + t, cap))
    return state, opened


def _block_pack(paras: DataFrame, max_tokens: int, doc_key: str, order_col: str, tokens_col: str,
                block_rows: int, schema: T.StructType) -> DataFrame:
    """Exact greedy packing of long documents split into blocks of positions.

    (1) each (document, block) computes its transfer function over all entry
    states (bounded by ``block_rows`` rows); (2) per document, the block
    summaries (one row per block) are chained in order to get each block's
    entry state and pack offset; (3) each block assigns its pack ids.
    """
    start = max_tokens + 2
    key_type = schema[doc_key].dataType.simpleString()
    blk = paras.select(doc_key, order_col, tokens_col,
                       F.floor(F.col(order_col) / F.lit(block_rows)).cast("long").alias("_blk"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        exit_state, opened = _transfer(pdf[tokens_col].to_numpy(), max_tokens)
        return pd.DataFrame({doc_key: [pdf[doc_key].iloc[0]], "_blk": [pdf["_blk"].iloc[0]],
                             "_exit": [exit_state.tolist()], "_opened": [opened.tolist()]})

    summaries = blk.groupBy(doc_key, "_blk").applyInPandas(
        summarise, f"{doc_key} {key_type}, _blk long, _exit array<long>, _opened array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", kind="stable")
        state, offset, entries, offsets = start, 0, [], []
        for ex, op in zip(pdf["_exit"], pdf["_opened"]):
            entries.append(state)
            offsets.append(offset)
            offset += int(op[state])
            state = int(ex[state])
        return pd.DataFrame({doc_key: pdf[doc_key].to_numpy(), "_blk": pdf["_blk"].to_numpy(),
                             "_entry": entries, "_offset": offsets})

    entry = summaries.groupBy(doc_key).applyInPandas(
        chain, f"{doc_key} {key_type}, _blk long, _entry long, _offset long")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        entry_state = int(pdf["_entry"].iloc[0])
        ids = _greedy_pack_ids(pdf[tokens_col].to_numpy(), max_tokens, None if entry_state == start else entry_state,
                               int(pdf["_offset"].iloc[0]))
        return pdf[[doc_key, order_col, tokens_col]].assign(pack_id=ids)

    return blk.join(entry, [doc_key, "_blk"]).groupBy(doc_key, "_blk").applyInPandas(assign, schema)


def pack_greedy(paras: DataFrame, max_tokens: int = 2000, doc_key: str = "doc_id",
                order_col: str = "para_idx", tokens_col: str = "n_tokens",
                block_rows: int = 100_000) -> DataFrame:
    """Greedy packing with reset, per document.

    Output: ``doc_key, order_col, tokens_col, pack_id`` for every input
    paragraph.  Only these narrow columns are written, once, and travel to
    Python, so the texts are read and counted once.  Documents with at most
    ``block_rows`` paragraphs stream through a sorted partition scan with the
    packing state carried along (constant memory); longer documents - a
    document may hold a large share of all paragraphs - are split into blocks
    of positions that are packed in parallel and chained exactly through
    per-block transfer functions, so no document is scanned by one task.
    """
    from answerlake.session import stored
    slim = stored(paras.select(doc_key, order_col, tokens_col), "pack-tokens")
    types = {f.name: f.dataType for f in slim.schema.fields}
    schema = T.StructType([T.StructField(c, types[c]) for c in (doc_key, order_col, tokens_col)] + [T.StructField("pack_id", T.LongType())])
    sizes = slim.groupBy(doc_key).agg((F.max(order_col) + 1).alias("_n"))
    tagged = slim.join(sizes, doc_key)
    small = tagged.filter(F.col("_n") <= block_rows).drop("_n")
    large = tagged.filter(F.col("_n") > block_rows).drop("_n")
    return (_stream_pack(small, max_tokens, doc_key, order_col, tokens_col, schema)
            .unionByName(_block_pack(large, max_tokens, doc_key, order_col, tokens_col, block_rows, schema)))


def pack_prefix(paras: DataFrame, max_tokens: int = 2000, doc_key: str = "doc_id",
                order_col: str = "para_idx", tokens_col: str = "n_tokens") -> DataFrame:
    """``pack = floor((running_tokens - 1) / max)`` per document (ours).

    Not identical to C2: a paragraph may straddle a boundary and is assigned
    by its last token.  Zero-token paragraphs at the start land in pack 0.
    """
    w = (Window.partitionBy(doc_key).orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = F.sum(tokens_col).over(w)
    return paras.withColumn("pack_id", F.greatest(F.floor((cum - 1) / F.lit(max_tokens)), F.lit(0))
                            .cast("bigint"))


def pack_stats(packed: DataFrame, keys: Sequence[str] = ("doc_id", "pack_id"),
               tokens_col: str = "n_tokens") -> DataFrame:
    return packed.groupBy(*keys).agg(F.count("*").alias("n_paragraphs"),
                                      F.sum(tokens_col).cast("bigint").alias("n_tokens"))
