"""Stretches of text that stand verbatim in more than one document.

Two operators share the hashing here.

:class:`SentenceRuns` cuts texts into sentences, hashes every run of
consecutive sentences that just reaches ``length`` characters, joins the runs
globally and removes the sentences covered by any run that stood somewhere
before. One row per sentence; it says what to remove. A stretch that begins or
ends inside sentences holds no whole run, so it can miss stretches.

:class:`SharedSpans` finds every common stretch of ``length`` code points:

1. A window of ``length`` characters is named by its *anchor*, the ``gram``
   characters inside it with the smallest hash. Neighbouring windows mostly
   share one, so a text has about two anchors per ``length - gram`` characters.
   Equal windows have equal anchors; anchors of one text only are dropped.
2. The windows of an anchor are taken in blocks of up to ``block`` neighbours.
   All windows of a block contain its *core* of ``length - block + 1``
   characters, so one row (the core's hash and the few characters left and
   right of it) stands for the block. Cores of one text only are dropped: a
   standing phrase shorter than a core causes nothing more, however common.
3. Rows of a core with the same characters around are one *class*. If a core
   has one class, all its windows have the same holders. Else the windows of
   its classes are compared one by one, classes only, not their holders.
4. Windows held by the same set of texts are folded to one before pairs are
   formed, so pairs are formed about once per result row.

Exact copies of texts are folded to one representative before all this.
Lengths and positions are in Unicode code points. Texts shorter than
``length`` (null and empty ones too) share nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowmill.plans.shared import broadcast_if_small, materialise

LENGTH, GRAM, BLOCK = 160, 60, 16
#: Code points hashed at once (a longer text is hashed alone).
CHUNK = 1 << 17
#: Second and later copies of texts up to which they are left out by a broadcast.
BROADCAST_COPIES = 1_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SALTS = (1, 0x632BE59BD9B4E019)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (shift, xor, multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))


_powers = tuple(_Powers(b) for b in _BASES)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Hashed:
    """Texts laid end to end, with 64-bit hashes of any span of them.

    The hash of a span is the difference of a polynomial prefix sum modulo
    2**64, scaled back to the span's start, so it depends on its characters only.
    """

    def __init__(self, texts: list[str]):
        self.joined = "".join(texts)
        self.cp = code_points(self.joined)
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self._sums: dict[int, np.ndarray] = {}

    def spans(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        p = _powers[which]
        if which not in self._sums:
            p.grow(len(self.cp) + 1)
            terms = _mix(self.cp.astype(np.uint64) + np.uint64(_SALTS[which])) * p.up[: len(self.cp)]
            self._sums[which] = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64)])
        s = self._sums[which]
        return _mix((s[end] - s[start]) * p.down[start])

    def grams(self, n: int) -> np.ndarray:
        """The hash of every run of ``n`` characters (also those across texts)."""
        m = len(self.cp) - n + 1
        self.spans(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        s = self._sums[0]
        return _mix((s[n:] - s[:m]) * _powers[0].down[:m])

    def anchored(self, length: int, gram: int) -> tuple[np.ndarray, ...]:
        """Anchors and the run of windows each names: ``text, at, first, last,
        hash`` (number of the text; position of the anchor, of the first and of
        the last window, all in the joined text). Leftmost of equal grams."""
        h, w = self.grams(gram), length - gram + 1
        pos, size = np.arange(len(h), dtype=np.int32), 1
        best = h
        while size < w:  # smallest of 2, 4, 8 ... neighbours; the last step overlaps
            step = min(size, w - size)
            a, b = best[: len(best) - step], best[step:]
            left = a <= b
            pos, best = np.where(left, pos[: len(pos) - step], pos[step:]), np.where(left, a, b)
            size += step
        if not len(pos):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none, h
        new = np.flatnonzero(pos[1:] != pos[:-1]) + 1
        new = np.union1d(new, self.starts[self.starts < len(pos)])  # the first window of each run, whether inside a text or not
        text = np.searchsorted(self.ends, new, side="right")
        last = np.minimum(np.append(new[1:], len(pos)) - 1, self.ends[text] - length)
        whole = last >= new
        new, last, text = new[whole], last[whole], text[whole]
        at = pos[new].astype(np.int64)
        return text, at, new, last, h[at]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Hashed]]:
    """Slices of batches whose texts come to about CHUNK code points."""
    for b in batches:
        texts = b.column(column).to_pylist()
        first, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > CHUNK:
                yield b.slice(first, i - first), Hashed(texts[first:i])
                first, size = i, 0
            size += len(t)
        if size:
            yield b.slice(first), Hashed(texts[first:])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _groups(batches, 1):
            text, _, _, _, h = t.anchored(length, gram)
            # a text of one repeated character has an anchor everywhere: once is enough
            once = np.unique(h ^ _mix(text.astype(np.uint64)), return_index=True)[1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[once])), _signed(h[once])], ["rep", "anchor"])

    return run


_BLOCKS = "rep bigint, at int, ka bigint, kb bigint, lo tinyint, hi tinyint, before string, after string"


def _block_rows(length: int, gram: int, block: int):
    core = length - block + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _groups(batches, 1):
            text, at, first, last, h = t.anchored(length, gram)
            wanted = b.column(2)
            asked = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            salt = lambda i: _mix(i.astype(np.uint64))
            here = np.isin(h ^ salt(text), wanted.flatten().to_numpy().view(np.uint64) ^ salt(asked))
            text, at, first, last = text[here], at[here], first[here], last[here]
            low, high = (at - last) // block, (at - first) // block  # distance of the anchor from a window's start, in blocks
            n = high - low + 1
            row = np.repeat(np.arange(len(at)), n)
            k = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = at[row] - k * block  # of the core
            lo, hi = np.maximum(start - last[row], 0), np.minimum(start - first[row], block - 1)
            end = start + core
            bounds = zip(start.tolist(), end.tolist(), lo.tolist(), hi.tolist(), strict=True)
            sides = [(t.joined[s - j : s], t.joined[e : e + block - 1 - i]) for s, e, i, j in bounds]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(text[row])), pa.array((start - t.starts[text[row]]).astype(np.int32)),
                _signed(t.spans(start, end, 0)), _signed(t.spans(start, end, 1)), pa.array(lo.astype(np.int8)), pa.array(hi.astype(np.int8)),
                pa.array([x for x, _ in sides], pa.string()), pa.array([y for _, y in sides], pa.string()),
            ], ["rep", "at", "ka", "kb", "lo", "hi", "before", "after"])

    return run


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text")).filter("doc IS NOT NULL")


def _sums(*column: str) -> list:
    """Four sums that tell multisets of representatives apart (124 bits)."""
    mask = F.lit(0x7FFFFFFF)
    return [F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(s), *column), n).bitwiseAND(mask)).alias(f"s{s}{n}") for s in (1, 2) for n in (0, 32)]


_SUMS = ["s10", "s132", "s20", "s232"]


class SharedSpans:
    """The shared stretches of one table of texts; results are its methods.

    ``key`` must be a unique BIGINT; rows without one are left out, and a row that
    is repeated as a whole counts once. Other columns are not looked at.
    """

    def __init__(self, df: DataFrame, key: str, text: str, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
        if not 0 < gram < length:
            raise ValueError("the anchor must be shorter than the window")
        self.length, self.gram, self.block = length, gram, max(1, min(block, length - gram, 128))
        self.texts = _named(df, key, text)
        long = self.texts.filter(F.char_length("text") >= length)
        hashed = long.select("doc", F.xxhash64("text").alias("ha"), F.xxhash64(F.lit(7), F.col("text")).alias("hb"), F.char_length("text").alias("n")).distinct()
        reps = hashed.groupBy("ha", "hb").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
        #: doc -> the representative of its exact copies, with their number
        self.members = materialise(hashed.join(reps, ["ha", "hb"]).select("doc", "rep", "copies", "n"), "members")
        again = broadcast_if_small(self.members.filter("doc <> rep").select("doc"), BROADCAST_COPIES)
        self.rows = self._blocks(long.join(again, "doc", "left_anti"))
        self.keys = self._keys()

    def _blocks(self, own: DataFrame) -> DataFrame:
        """Block rows of representatives whose anchor and core several of them hold."""
        found = materialise(own.mapInArrow(_anchor_rows(self.length, self.gram), "rep bigint, anchor bigint"), "anchors")
        several = lambda df, *by: df.groupBy(*by).agg(F.min("rep").alias("_a"), F.max("rep").alias("_b")).filter("_a < _b").select(*by)
        # a text holds at most one anchor per character: the list is as bounded as the text
        lists = found.join(several(found, "anchor"), "anchor").groupBy("rep").agg(F.collect_set("anchor").alias("wanted"))
        chosen = own.withColumnRenamed("doc", "rep").join(lists, "rep").select("rep", "text", "wanted")
        rows = materialise(chosen.mapInArrow(_block_rows(self.length, self.gram, self.block), _BLOCKS), "blocks")
        kind = ["ka", "kb", "lo", "hi", "before", "after"]
        held = rows.join(several(rows, "ka", "kb"), ["ka", "kb"], "left_semi")
        return materialise(held.withColumns({"ca": F.xxhash64(*kind), "cb": F.xxhash64(F.lit(5), *kind)}), "shared-blocks")

    def _keys(self) -> DataFrame:
        """``wa, wb, ca, cb, lo, hi, a, n, s...``: the windows of each class, with
        the number, sums and first of the class's holders. One row for a class
        that is its core's only one (its windows have the same holders), else
        one row per window."""
        kind = ["ka", "kb", "ca", "cb", "lo", "hi"]
        classes = self.rows.groupBy(*kind).agg(
            F.first("before").alias("before"), F.first("after").alias("after"), F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b"), *_sums("rep")
        )
        lone = classes.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("ka", "kb", F.lit(True).alias("_lone"))
        marked = classes.join(lone, ["ka", "kb"], "left").withColumn("_lone", F.coalesce("_lone", F.lit(False)))
        j = F.col("j")
        each = marked.withColumn("j", F.explode(F.when(F.col("_lone"), F.array(F.lit(-1))).otherwise(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int")))))
        left = F.when(j >= 0, F.substring("before", F.char_length("before") - j + 1, j)).otherwise("")
        right = F.when(j >= 0, F.substring("after", F.lit(1), F.lit(self.block - 1) - j)).otherwise("")
        window = [F.col("ka"), F.col("kb"), j, left, right]
        one = each.select(F.xxhash64(*window).alias("wa"), F.xxhash64(F.lit(9), *window).alias("wb"), "ca", "cb",
                          F.when(j >= 0, j).otherwise(F.col("lo")).alias("lo"), F.when(j >= 0, j).otherwise(F.col("hi")).alias("hi"), "n", "a", "b", *_SUMS)
        return materialise(one, "window-keys")

    def windows(self) -> DataFrame:
        """``wa, wb, least, n, s...``: windows that several distinct texts hold."""
        held = self.keys.groupBy("wa", "wb").agg(F.min("a").alias("least"), F.max("b").alias("_b"), F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in _SUMS])
        return held.filter("least < _b").drop("_b")

    def rep_pairs(self) -> DataFrame:
        """``rep_a, rep_b`` (rep_a < rep_b): representatives that share a window.

        Of all windows held by the same set of texts one is kept, so a set's
        pairs are formed once, not once per window.
        """
        one = self.windows().groupBy("n", *_SUMS).agg(F.min(F.struct("wa", "wb")).alias("w")).select("w.wa", "w.wb")
        held = self.keys.join(one, ["wa", "wb"]).select("wa", "wb", "ca", "cb").join(self.rows.select("ca", "cb", "rep"), ["ca", "cb"])
        held = held.select("wa", "wb", "rep").distinct()
        a, b = held.withColumnRenamed("rep", "rep_a"), held.withColumnRenamed("rep", "rep_b")
        return a.join(b, ["wa", "wb"]).filter("rep_a < rep_b").select("rep_a", "rep_b").distinct()

    def pairs(self) -> DataFrame:
        """``doc_a, doc_b`` (doc_a < doc_b): every pair of different documents
        that share a window, copies expanded from their representatives."""
        m = self.members.select("doc", "rep")
        a, b = m.select(F.col("doc").alias("x"), F.col("rep").alias("rep_a")), m.select(F.col("doc").alias("y"), F.col("rep").alias("rep_b"))
        across = self.rep_pairs().join(a, "rep_a").join(b, "rep_b").select("x", "y")
        copied = self.members.filter("copies > 1").select("doc", "rep")
        within = copied.withColumnRenamed("doc", "x").join(copied.withColumnRenamed("doc", "y"), "rep").filter("x < y").select("x", "y")
        return across.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def stretches(self) -> DataFrame:
        """``rep, begin, end, least``: parts of representatives that ``least``, the
        first holder, and others have as well (parts may overlap)."""
        j = self.keys.join(self.windows().select("wa", "wb", "least"), ["wa", "wb"]).select("ca", "cb", "least", F.explode(F.sequence("lo", "hi")).alias("j"))
        sets = j.groupBy("ca", "cb", "least").agg(F.sort_array(F.collect_set("j")).alias("js"))  # at most ``block`` of them
        edge = lambda by: F.filter("js", lambda x: ~F.array_contains(F.col("js"), x + by))
        runs = sets.select("ca", "cb", "least", F.explode(F.arrays_zip(edge(-1).alias("f"), edge(1).alias("t"))).alias("r"))
        return self.rows.select("ca", "cb", "rep", "at").join(runs, ["ca", "cb"]).select(
            "rep", (F.col("at") - F.col("r.t")).alias("begin"), (F.col("at") - F.col("r.f") + self.length).alias("end"), "least"
        )

    def report(self) -> DataFrame:
        """Per document: ``doc, rep, copies, n_chars, shared_chars`` (inside a
        stretch that another document has), ``repeated_chars`` (inside one that
        an earlier document has, so removing them keeps each stretch once)."""
        parts = materialise(self.stretches(), "stretches")
        shared, again = _covered(parts, "s"), _covered(parts.filter("rep > least"), "r")
        docs = self.texts.select("doc", F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"))
        out = docs.join(self.members.select("doc", "rep", "copies"), "doc", "left").join(shared, "rep", "left").join(again, "rep", "left")
        copy = F.coalesce(F.col("copies"), F.lit(1)) > 1
        whole, rest = F.col("n_chars").cast("bigint"), F.lit(0).cast("bigint")
        return out.select(
            "doc", F.coalesce("rep", "doc").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), whole.alias("n_chars"),
            F.when(copy, whole).otherwise(F.coalesce("s", rest)).alias("shared_chars"),
            F.when(copy & (F.col("doc") > F.col("rep")), whole).otherwise(F.coalesce("r", rest)).alias("repeated_chars"),
        )


def _covered(parts: DataFrame, name: str) -> DataFrame:
    """Characters inside any of a text's parts (the length of their union)."""
    upto = F.max("end").over(Window.partitionBy("rep").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("begin"), F.coalesce("upto", F.lit(0))), F.lit(0))
    return parts.select("rep", "begin", "end").distinct().withColumn("upto", upto).groupBy("rep").agg(F.sum(new).alias(name))


# --- sentences ----------------------------------------------------------------

# Code points that end a sentence before a blank, that end one anywhere, and blanks.
_STOPS, _HARD = [ord(c) for c in ".!?…"], [ord(c) for c in "\n\r。！？  "]
_BLANKS = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def sentences(t: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``text, begin, end`` of every sentence (without outer blanks), in order.

    A sentence ends after a stop that a blank or the end of the text follows, or
    after a line break or full-width stop.
    """
    n = len(t.cp)
    blank, edge = np.isin(t.cp, _BLANKS), np.zeros(n + 1, dtype=bool)
    edge[t.starts] = edge[t.ends] = True
    follows = np.append(blank[1:], True) | edge[1:]
    cut = edge.copy()
    cut[1:] |= np.isin(t.cp, _HARD) | (np.isin(t.cp, _STOPS) & follows)
    solid = np.flatnonzero(~blank)
    piece = np.cumsum(cut[:n])[solid]  # number of the piece each solid character is in
    first = np.flatnonzero(np.diff(piece, prepend=-1) != 0)
    last = np.append(first[1:], len(piece)) - 1 if len(piece) else first
    begin, end = solid[first], solid[last] + 1
    return np.searchsorted(t.ends, begin, side="right"), begin, end


def _runs(t: Hashed, length: int) -> tuple[np.ndarray, ...]:
    """``text, number, begin, end, ka, kb``: from every sentence the shortest run
    of sentences with at least ``length`` characters."""
    text, begin, end = sentences(t)
    number = np.arange(len(text)) - np.searchsorted(text, text, side="left")
    to = np.searchsorted(end, begin + length, side="left")
    whole = to < len(text)
    whole[whole] = text[to[whole]] == text[whole]
    at, to = np.flatnonzero(whole), to[whole]
    return text[at], number[at], number[to], t.spans(begin[at], end[to], 0), t.spans(begin[at], end[to], 1)


def _run_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, t in _groups(batches, 1):
            text, first, last, ka, kb = _runs(t, length)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _signed(ka), _signed(kb)], ["doc", "first", "last", "ka", "kb"])

    return run


def _cleaned_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, covered = b.column(1).to_pylist(), b.column(2).to_pylist()
        out, total, gone, lost = [], [], [], []
        for text, runs in zip(texts, covered, strict=True):
            t = Hashed([text or ""])
            _, begin, end = sentences(t)
            drop = np.zeros(len(begin) + 1, dtype=np.int64)
            for r in runs or []:
                drop[r["first"]] += 1
                drop[r["last"] + 1] -= 1
            gone_here = np.cumsum(drop[:-1]) > 0
            kept, at = [], 0
            for s in np.flatnonzero(gone_here).tolist():  # a sentence goes with the blanks after it
                kept.append(t.joined[at : begin[s]])
                at = begin[s + 1] if s + 1 < len(begin) else len(t.joined)
            kept.append(t.joined[at:])
            out.append(None if text is None else "".join(kept))
            total.append(len(begin)), gone.append(int(gone_here.sum())), lost.append(int((end - begin)[gone_here].sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(total, pa.int32()), pa.array(gone, pa.int32()), pa.array(lost, pa.int64())], ["doc", "text", "sentences", "removed", "removed_chars"])


class SentenceRuns:
    """Sliding runs of sentences, hashed and joined over all texts.

    A run is the shortest sequence of consecutive sentences from a given one
    with at least ``length`` characters; equal runs have equal hashes (128
    bits). The first place of a run is the one in the smallest document, there
    the earliest. ``key`` must be a unique BIGINT; rows without one are left
    out. Null, empty and short texts have no run and stay as they are.
    """

    def __init__(self, df: DataFrame, key: str, text: str, length: int = LENGTH):
        self.texts = _named(df, key, text)
        rows = self.texts.filter(F.char_length("text") >= length).mapInArrow(_run_rows(length), "doc bigint, first int, last int, ka bigint, kb bigint")
        self.runs = materialise(rows, "sentence-runs")

    def groups(self) -> DataFrame:
        """``ka, kb, place, other``: runs that stand in several places,
        with the first and the last of them (folded on the map side, one row per run)."""
        place = F.struct("doc", "first")
        return self.runs.groupBy("ka", "kb").agg(F.min(place).alias("place"), F.max(place).alias("other")).filter("place < other")

    def repeats(self) -> DataFrame:
        """``doc, first, last``: runs that stood before, all but the first of each."""
        j = self.runs.join(self.groups().select("ka", "kb", "place"), ["ka", "kb"])
        return j.filter(F.struct("doc", "first") > F.col("place")).select("doc", "first", "last")

    def cleaned(self) -> DataFrame:
        """``doc, text, sentences, removed, removed_chars``: every text without the
        sentences that a non-first run covers."""
        # at most one run per sentence of a text: the list is as bounded as the text
        per = self.repeats().groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
        return self.texts.join(per, "doc", "left").select("doc", "text", "runs").mapInArrow(_cleaned_rows, "doc bigint, text string, sentences int, removed int, removed_chars bigint")

    def pairs(self) -> DataFrame:
        """``doc_a, doc_b`` (doc_a < doc_b): documents with a run in common. Runs
        with the same set of documents are folded to one before pairs are formed."""
        runs = self.runs.select("ka", "kb", "doc").distinct()
        sets = runs.groupBy("ka", "kb").agg(F.count(F.lit(1)).alias("n"), *_sums("doc")).filter("n > 1")
        one = sets.groupBy("n", *_SUMS).agg(F.min(F.struct("ka", "kb")).alias("k")).select("k.ka", "k.kb")
        held = runs.join(one, ["ka", "kb"])
        a, b = held.withColumnRenamed("doc", "doc_a"), held.withColumnRenamed("doc", "doc_b")
        return a.join(b, ["ka", "kb"]).filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()
