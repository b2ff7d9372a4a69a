"""Fill-in-middle examples: whole texts cut at two units into prefix, middle and suffix, put in another order between sentinels.

A text is seen as fixed blocks of ``block`` bytes. Two Fenwick trees per text hold how many units and how many code points start in each
block. The start of unit k is found by binary lifting: from the largest power of two downwards the descent takes every subtree whose units
still lie before k, summing its code points on the way; what is left is a place inside one block, and only this block's bytes are searched.
The trees of all texts of a slice are built, and all their cuts descended, together.

Units are code points, or words (a run of characters other than ASCII white space with the white space behind it; white space at the start
belongs to the first word, and a text of white space alone is one unit). The cuts of a text follow from its id and ``seed`` only, so an
example doesn't depend on partitions or on other rows: rows that repeat an id get the same cuts of their own texts, and all rows with a null
id hash as an empty id. Null and empty texts have 0 units and stay plain, as do texts that hold a sentinel. A text may be as long as Spark's
Arrow strings allow (2 GB with the sentinels); memory is that of one slice of about a megabyte, or of one text. Columns besides id and text
are ignored, so names that clash do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.llm.common import slices, text_buffers

SENTINELS = ("<P>", "<S>", "<M>")
RATE, SPM = 90, 20
BLOCK = 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether a code point starts at each byte."""
    return (data & 0xC0) != 0x80


def words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a word starts at each byte; a text's first unit starts with the text."""
    blank = _SPACE[data]
    out = ~blank
    out[1:] &= blank[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    out[first] = True
    # The first word after leading white space is part of the unit that began with the text.
    lead = first[blank[first]]
    starts = np.flatnonzero(out)
    after = starts[np.minimum(np.searchsorted(starts, lead, "right"), max(len(starts) - 1, 0))] if len(starts) else starts
    ends = offsets[np.searchsorted(offsets, lead, "right")]
    inside = (after > lead) & (after < ends)
    out[after[inside]] = False
    return out


class BlockTrees:
    """One Fenwick tree per text over its blocks, for each of several kinds of marks; all trees lie in one array."""

    def __init__(self, offsets: np.ndarray, marks: list[np.ndarray], block: int = BLOCK):
        self.offsets, self.marks, self.block = offsets, marks, block
        self.blocks = -(-np.diff(offsets) // block)
        self.base = np.cumsum(self.blocks) - self.blocks  # where a text's tree begins; its first place is number 1
        place = np.arange(self.blocks.sum()) - np.repeat(self.base, self.blocks)
        starts = np.repeat(offsets[:-1], self.blocks) + place * block
        self.trees = [np.add.reduceat(m.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for m in marks]
        number, most = place + 1, np.repeat(self.blocks, self.blocks)
        step = 1
        while step <= self.blocks.max(initial=0):
            up = np.flatnonzero(((number & -number) == step) & (number + step <= most))
            for tree in self.trees:
                tree[up + step] += tree[up]  # each of these has a place of its own above it
            step *= 2

    def totals(self, kind: int) -> np.ndarray:
        """Marks of each text: the sum over the places that the binary form of its number of blocks names."""
        out, place = np.zeros(len(self.blocks), np.int64), self.blocks.copy()
        while place.any():
            on = place > 0
            out[on] += self.trees[kind][self.base[on] + place[on] - 1]
            place &= place - 1
        return out

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte (in the text) at which unit ``wanted`` of each text starts, its end for a number that is too large; and the code points before it."""
        place, left, points = np.zeros(len(self.blocks), np.int64), wanted.astype(np.int64).copy(), np.zeros(len(self.blocks), np.int64)
        step = 1 << int(self.blocks.max(initial=0)).bit_length()
        while step:
            ahead = place + step
            on = np.flatnonzero(ahead <= self.blocks)
            below = self.trees[0][self.base[on] + ahead[on] - 1]
            on, below = on[below <= left[on]], below[below <= left[on]]
            points[on] += self.trees[1][self.base[on] + ahead[on] - 1]
            left[on] -= below
            place[on] += step
            step //= 2
        sizes = np.diff(self.offsets)
        at = np.minimum(place * self.block, sizes)
        inside = np.flatnonzero(place < self.blocks)
        for a in range(0, len(inside), 2048):
            rows = inside[a : a + 2048]
            grid = (self.offsets[rows] + at[rows])[:, None] + np.arange(self.block)
            fine = grid < self.offsets[rows + 1][:, None]
            grid = np.minimum(grid, self.offsets[-1] - 1)
            seen = np.cumsum(self.marks[0][grid] & fine, axis=1)
            offset = (seen <= left[rows][:, None]).sum(axis=1)  # bytes before the wanted mark
            offset = np.minimum(offset, sizes[rows] - at[rows])
            counted = np.cumsum(self.marks[1][grid] & fine, axis=1)
            points[rows] += np.where(offset > 0, counted[np.arange(len(rows)), np.maximum(offset, 1) - 1], 0)
            at[rows] += offset
        return at, points


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def assemble(form: str, prefix: bytes, middle: bytes, suffix: bytes, sentinels: tuple[bytes, bytes, bytes]) -> bytes:
    p, s, m = sentinels
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def examples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, units: str = "code_points", seed: int = 1, rate: int = RATE, spm: int = SPM,
             sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK) -> DataFrame:
    """Per row: id_col, n (units), form (plain, psm, spm), prefix_chars, middle_chars, prefix_units, middle_units (null if plain), output.

    ``rate`` percent of the texts are transformed, ``spm`` percent of these with the suffix first. A sentinel may not be empty or hold another,
    and their first characters may stand nowhere else in them; so no other sentinel can arise where a part and a sentinel meet.
    """
    if units not in ("code_points", "words"):
        raise ValueError(f"units are code_points or words, not {units}")
    if any(not a or any(a in b for j, b in enumerate(sentinels) if j != i) for i, a in enumerate(sentinels)):
        raise ValueError("a sentinel may not be empty or part of another")
    if any(a[0] in b[1:] for a in sentinels for b in sentinels):
        raise ValueError("the first character of a sentinel may stand nowhere else in one")
    marks = tuple(s.encode() for s in sentinels)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            keys = batch.column(1).to_pylist()
            for a, b in slices(offsets):
                part = offsets[a : b + 1] - offsets[a]
                bytes_ = data[offsets[a] : offsets[b]]
                points = code_points(bytes_)
                trees = BlockTrees(part, [points if units == "code_points" else words(bytes_, part), points], block)
                n = trees.totals(0)
                drawn = [draws(seed, k or "") for k in keys[a:b]]
                cuts = np.array([(h[0] % (k + 1), h[1] % (k + 1)) for h, k in zip(drawn, n.tolist())], np.int64).reshape(-1, 2)
                cuts.sort(axis=1)
                (first, before), (second, until) = trees.find(cuts[:, 0]), trees.find(cuts[:, 1])
                whole, forms, outputs = bytes_.tobytes(), [], []
                for i, h in enumerate(drawn):
                    text = whole[part[i] : part[i + 1]]
                    form = "plain" if not text or h[2] % 100 >= rate or any(m in text for m in marks) else "spm" if h[3] % 100 < spm else "psm"
                    x, y = first[i], second[i]
                    forms.append(form)
                    outputs.append(text if form == "plain" else assemble(form, text[:x], text[x:y], text[y:], marks))
                plain = np.array([f == "plain" for f in forms], bool)
                column = lambda v: pa.array(v, pa.int64(), mask=plain)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n), pa.array(forms, pa.string()), column(before), column(until - before),
                                       column(cuts[:, 0]), column(cuts[:, 1] - cuts[:, 0]), pa.array(outputs, pa.binary()).cast(pa.string())],
                                      names=[id_col, "n", "form", "prefix_chars", "middle_chars", "prefix_units", "middle_units", "output"])

    kind = docs.select(id_col).dtypes[0][1]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), F.col(text_col).alias("_text"))
    out = f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, prefix_units long, middle_units long, output string"
    return narrow.mapInArrow(run, out)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an example's output and form. A sentinel's first place is the one that was put there: no part holds one."""
    p, s, m = sentinels

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(opening) + 1), F.length(output))
        first = F.split_part(body, F.lit(between), F.lit(1))
        rest = F.substring(body, F.length(first) + len(between) + 1, F.length(body))
        second = F.split_part(rest, F.lit(m), F.lit(1))
        return first, second, F.substring(rest, F.length(second) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))
