"""Operator 12: fill-in-middle, cut at line ends through a learned rank index.

Texts travel in blocks. All line ends of a block are one rising sequence of offsets, and a
cut asks for the offset of a rank in it. ``RankIndex`` answers without keeping the sequence:
segments of a piecewise-linear function, each fitted greedily so that no offset is further
than ``ERROR`` bytes from its line, predict the offset; the stored residual of the rank, a
small integer, corrects it exactly.

Results in odd cases: a null text is the empty text; an empty text is plain with no lines.
A row without an id has no hash and is plain with a null id. Rows with the same id are cut
by the same hash, each in its own text. Extra columns are left out. A task holds one block
(about 2 MB of text, or one longer text with some twenty bytes for each of its lines).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm import buffers

ERROR = 512
SEED = 7
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
CUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class RankIndex:
    """Offsets by rank: error-bounded linear segments and one small residual for each rank."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        offsets = np.asarray(offsets, np.int64)
        starts, slopes, at = [], [], 0
        while at < len(offsets):
            end, slope = self._reach(offsets, at, error)
            starts.append(at)
            slopes.append(slope)
            at = end
        self.starts, self.slopes = np.array(starts, np.int64), np.array(slopes)
        self.bases = offsets[self.starts]
        left = offsets - self.predicted(np.arange(len(offsets)))
        kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if not len(left) or np.abs(left).max() <= np.iinfo(k).max)
        self.residuals = left.astype(kind)

    @staticmethod
    def _reach(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """The first rank that no line through this segment's start serves, and the slope for those before it."""
        low, high, width, i = -np.inf, np.inf, 64, at + 1
        while i < len(offsets):
            end = min(len(offsets), i + width)
            run, rise = np.arange(i, end) - at, offsets[i:end] - offsets[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            bad = np.flatnonzero(lows > highs)
            if len(bad):
                if bad[0]:
                    low, high = lows[bad[0] - 1], highs[bad[0] - 1]
                return i + int(bad[0]), (low + high) / 2 if np.isfinite(low) else 0.0
            low, high, i, width = lows[-1], highs[-1], end, width * 4
        return len(offsets), (low + high) / 2 if np.isfinite(low) else 0.0

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        segment = np.searchsorted(self.starts, ranks, side="right") - 1
        return self.bases[segment] + np.rint(self.slopes[segment] * (ranks - self.starts[segment])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of the ranks."""
        return self.predicted(ranks) + self.residuals[ranks].astype(np.int64)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 and the ends of all lines of a block, and for every text the rank at which it begins."""
    filled = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(np.flatnonzero(data == 10).astype(np.int64) + 1, filled)
    return np.r_[0, ends].astype(np.int64), np.searchsorted(ends, offsets, side="right")


def drawn(doc_id: int, seed: int) -> list[int]:
    """h1 to h4: the first four groups of eight hex digits."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transformed(docs: DataFrame, seed: int = SEED, percent: int = 100, spm_percent: int = 50, error: int = ERROR) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every row.

    ``percent`` of the texts are rearranged, ``spm_percent`` of those suffix first; texts that
    hold a mark stay plain.
    """
    p, s, m = (MARKS[k].encode() for k in ("prefix", "suffix", "middle"))

    def run(batches):
        for batch in (b for whole in batches for b in buffers.blocks([whole])):
            data, offsets = buffers.flat(batch.column("text"))
            ends, ranks = line_ends(data, offsets)
            index = RankIndex(ends, error)
            ids, lines = batch.column("doc_id").to_pylist(), np.diff(ranks)
            draws = [None if i is None else drawn(i, seed) for i in ids]
            cuts = np.array([[0, 0] if h is None else sorted((h[0] % (n + 1), h[1] % (n + 1)))
                             for h, n in zip(draws, lines.tolist())], np.int64).reshape(-1, 2)
            places = index.at(ranks[:-1, None] + cuts) if len(ids) else cuts
            lead = (data & 0xC0) != 0x80
            forms, heads, middles, out = [], [], [], []
            for i, h in enumerate(draws):
                a, b = offsets[i], offsets[i + 1]
                text = data[a:b].tobytes()
                if h is None or not text or h[2] % 100 >= percent or any(mark in text for mark in (p, s, m)):
                    forms.append("plain"), heads.append(None), middles.append(None), out.append(text)
                    continue
                x, y = places[i].tolist()
                heads.append(int(np.count_nonzero(lead[a:x])))
                middles.append(int(np.count_nonzero(lead[x:y])))
                head, middle, tail = text[:x - a], text[x - a:y - a], text[y - a:]
                forms.append("spm" if h[3] % 100 < spm_percent else "psm")
                out.append(b"".join((s, tail, p, head, m, middle) if forms[-1] == "spm" else (p, head, s, tail, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CUT)


def restored(output, form):
    """The text that an output of a form was made from. No mark can begin inside a text and end in the mark behind it."""
    def after(text, part):
        return F.substr(text, F.length(part) + F.lit(4))
    body = F.substr(output, F.lit(4))
    first = F.when(form == "spm", F.substring_index(body, MARKS["prefix"], 1)).otherwise(F.substring_index(body, MARKS["suffix"], 1))
    rest = after(body, first)
    second = F.substring_index(rest, MARKS["middle"], 1)
    middle = after(rest, second)
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))


def digests(docs: DataFrame) -> DataFrame:
    """The result of op12: outputs and the texts rebuilt from them as digests."""
    rebuilt = transformed(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return rebuilt.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("restored", 256).alias("restored_sha256"))
