"""Fill-in-middle transformation, as a pipeline of Arrow kernels a batch.

A text is cut into lines (``[^\\n]*\\n|[^\\n]+``).  For a batch of documents the
lines of all of them become list arrays, are flattened with the row each comes
from, numbered within their document, filtered by role (prefix, middle,
suffix), rebuilt into a list a document, and the lists and markers are put
together by ``binary_join`` and ``binary_join_element_wise``; no text is
handled by Python code.

The cut points come from the SHA-256 of ``seed:doc_id``, whose first four
8-digit groups are h1 to h4: the prefix ends after the smaller of h1 % (n + 1)
and h2 % (n + 1) lines, the middle after the larger.  Form ``plain`` (the text
as it is) is taken if the text is empty or holds a marker, or if h3 % 100 >=
``rate``; else ``spm`` if h4 % 100 < ``spm_rate``, else ``psm``:

    psm: <P>prefix<S>suffix<M>middle        spm: <S>suffix<P>prefix<M>middle

A form other than plain holds each marker once, since no marker can begin or
end inside another one, so ``restored`` rebuilds the text from output and form
alone, by native expressions.

Cases: a null text counts as empty (plain, no lines, empty output).  A null
doc_id is hashed as ``seed:`` and comes back as null.  Rows that repeat a
doc_id are cut alike.  Texts of any length are handled whole (a worker takes
about a megabyte of text at a time, a longer text alone).  An empty table gives
no rows.  Only ``doc_id`` and ``text`` are read, so other columns' names cannot
clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_slices, text_buffer, text_or_empty

SEED = 7
RATE = 100
SPM_RATE = 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _draws(seed: int) -> list[Column]:
    """h1 to h4 of a row, from 0 to 2**32 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _units(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of the texts, flattened, with the row that each comes from."""
    pieces = pc.split_pattern(text, "\n")
    row = pc.list_parent_indices(pieces).to_numpy()
    flat = pc.list_flatten(pieces)
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    # the piece after the last newline has none, and is no line when empty
    ends = pc.if_else(pa.array(last), pa.scalar("", text.type), pa.scalar("\n", text.type))
    flat = pc.binary_join_element_wise(flat, ends, pa.scalar("", text.type))
    keep = ~last | (pc.binary_length(flat).to_numpy() > 0)
    return flat.filter(pa.array(keep)), row[keep]


def _joined(units: pa.Array, row: np.ndarray, role: np.ndarray, rows: int) -> pa.Array:
    """For each document its units of a role (a mask), joined."""
    sizes = np.bincount(row[role], minlength=rows)
    lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int64()), units.filter(pa.array(role)))
    return pc.binary_join(lists, pa.scalar("", units.type))


def transform_batch(text: pa.Array, h: list[np.ndarray], rate: int, spm_rate: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of a batch of texts."""
    rows = len(text)
    units, row = _units(text)
    n = np.bincount(row, minlength=rows)
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    lo, hi = np.minimum(a, b)[row], np.maximum(a, b)[row]
    before, after = ordinal < lo, ordinal >= hi
    prefix, middle, suffix = (_joined(units, row, m, rows) for m in (before, ~before & ~after, after))
    marked = np.zeros(rows, bool)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= rate)
    spm = ~plain & (h[3] % 100 < spm_rate)
    kind = text.type
    p, s, m, none = (pa.scalar(x, kind) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    join = pc.binary_join_element_wise
    output = pc.if_else(pa.array(plain), text, pc.if_else(
        pa.array(spm), join(s, suffix, p, prefix, m, middle, none), join(p, prefix, s, suffix, m, middle, none)))
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")))
    chars = [pa.array(pc.utf8_length(x).to_numpy().astype(np.int64), mask=plain) for x in (prefix, middle)]
    return [pa.array(n.astype(np.int64)), form, *chars, output.cast(pa.string())]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars and
    middle_chars (code points; null if plain) and the output text."""
    def run(batches):
        for batch in batches:
            text = batch.column(1)
            _, off = text_buffer(text)
            wide = text.cast(pa.large_string())
            h = [batch.column(2 + k).to_numpy() for k in range(4)]
            for lo, hi in row_slices(off):
                part = transform_batch(wide.slice(lo, hi - lo), [x[lo:hi] for x in h], rate, spm_rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *part],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return rows.select("doc_id", "text", *_draws(seed)).mapInArrow(run, _OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form were made from."""
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring_index(output, MIDDLE, 1)
    inner = lambda x, first: F.substr(F.substring_index(x, first, 1), F.lit(4))  # noqa: E731  the leading marker goes
    psm = F.concat(inner(rest, SUFFIX), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, inner(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
