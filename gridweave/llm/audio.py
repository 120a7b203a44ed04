"""Audio columns: chroma fingerprints and their alignment.

A recording (16-bit mono samples in a binary column) becomes frames of twelve
pitch classes. Filters over the integral image of these frames compare sums
of rectangles; each gives two bits, and sixteen of them one packed integer a
frame. Recordings with the same integers form a class. Queries meet other
classes at equal integers, looked up where an integer differs from the one
before; the histogram of offsets between the places finds candidates, in which
a sustained integer counts by its frames too, and the share of differing bits
over the overlap decides among all of a pair's candidates.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gridweave.llm.shared import parts, saved, slices

#: Samples a second, of a frame, and from one frame to the next.
RATE, FRAME, HOP = 4000, 1024, 256
#: Frequencies that have a pitch class.
LOWEST, HIGHEST = 60.0, 1800.0
#: Equal changes at one offset, or frames that such integers last in both, that make a candidate, and the share of bits that may differ.
LEAST_VOTES, LEAST_FRAMES, MOST_ERRORS = 3, 16, 0.25
FILTERS = [(k % 6, (5 * k) % 12, 1 + k % 4, 2 + 2 * (k % 7)) for k in range(16)]
#: Edges between a filter's four values, as the difference of two sums of logarithms per cell.
EDGES = np.array([-0.8, 0.0, 0.8])
#: Integers that are made at a time, whatever a recording's length.
STRETCH = 2048


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of energy in twelve pitch classes, each frame of length one; silence is all zeros."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / rate)
    used = np.nonzero((hertz >= LOWEST) & (hertz <= HIGHEST))[0]
    classes = np.round(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    out = np.zeros((len(frames), 12))
    for c in range(12):
        out[:, c] = power[:, used[classes == c]].sum(axis=1)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-3)


def _parts(kind: int, y: int, h: int, w: int) -> tuple[list, list]:
    """Rectangles (time, class, time, class) whose sums are compared."""
    half, third, mid = w // 2, max(1, w // 3), max(1, h // 2)
    return [
        ([(0, y, w, h)], []),
        ([(0, y, w, mid)], [(0, y + mid, w, max(1, h - mid))]),
        ([(0, y, half, h)], [(half, y, w - half, h)]),
        ([(0, y, half, mid), (half, y + mid, w - half, max(1, h - mid))], [(half, y, w - half, mid), (0, y + mid, half, max(1, h - mid))]),
        ([(0, y + h, w, h)], [(0, y, w, h), (0, y + 2 * h, w, h)]),
        ([(third, y, third, h)], [(0, y, third, h), (2 * third, y, max(1, w - 2 * third), h)]),
    ][kind]


def fingerprint(samples: np.ndarray, rate: int = RATE, stretch: int = STRETCH) -> np.ndarray:
    """A packed integer (uint32) for each frame that all filters fit on.

    Recordings go by overlapping stretches of ``stretch`` integers, so what is
    held beside samples and integers doesn't grow with their length. A filter's
    value is rounded before it meets the edges: an integer depends on the sound
    alone, not on where in a recording or a stretch it stands.
    """
    widest = max(w for *_, w in FILTERS)
    frames = (len(samples) - FRAME) // HOP + 1 if len(samples) >= FRAME else 0
    count = max(0, frames - widest + 1)
    out = np.empty(count, np.uint32)
    for first in range(0, count, stretch):
        n = min(stretch, count - first)
        last = first + n + widest - 2
        out[first : first + n] = _codes(chroma(samples[first * HOP : last * HOP + FRAME], rate), n)
    return out


def fingerprints(recordings: list[np.ndarray], rate: int = RATE) -> list[np.ndarray]:
    """The integers of several recordings, played one after the other from places where a frame starts: those that reach over an end are left out."""
    gaps = [np.zeros(-len(r) % HOP, "<i2") for r in recordings]
    starts = np.cumsum([0] + [(len(r) + len(g)) // HOP for r, g in zip(recordings, gaps, strict=True)])
    codes = fingerprint(np.concatenate([x for pair in zip(recordings, gaps, strict=True) for x in pair]), rate) if recordings else np.empty(0, np.uint32)
    widest = max(w for *_, w in FILTERS)
    counts = [max(0, (len(r) - FRAME) // HOP + 2 - widest) for r in recordings]
    return [codes[a : a + n] for a, n in zip(starts, counts)]


def _codes(frames: np.ndarray, count: int) -> np.ndarray:
    """The packed integers of the first ``count`` frames, by filters over the integral image of all."""
    around = np.concatenate((frames, frames, frames), axis=1)  # pitch classes go round
    image = np.zeros((len(frames) + 1, around.shape[1] + 1))
    image[1:, 1:] = around.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(count)

    def mean(rects: list) -> np.ndarray:
        total, cells = np.zeros(count), 0
        for t, y, w, h in rects:
            total += image[at + t + w, y + h] - image[at + t, y + h] - image[at + t + w, y] + image[at + t, y]
            cells += w * h
        return np.log(1e-3 + np.maximum(total, 0) / max(cells, 1)) if cells else np.full(count, math.log(0.2))

    out = np.zeros(count, np.uint32)
    for k, spec in enumerate(FILTERS):
        more, less = (mean(rects) for rects in _parts(*spec))
        level = np.searchsorted(EDGES, np.round(more - less, 6))
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)  # neighbouring levels differ in one bit
    return out


def tones(notes: np.ndarray, rate: int = RATE, length: int = HOP) -> np.ndarray:
    """16-bit samples of a melody: each note (semitones above 110 Hz) for ``length`` samples."""
    hertz = np.repeat(110.0 * 2.0 ** (np.asarray(notes, float) / 12), length)
    wave = np.sin(2 * np.pi * np.cumsum(hertz) / rate)
    return (12000 * wave).astype("<i2")


def recordings(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """rec_id, pcm: each vector played as a melody, a note a component, silence for null and non-finite ones; null vectors give null."""

    def run(batches):
        for b in slices(batches, 256):
            pcm = []
            for v in b.column("v").to_pylist():
                x = np.array([np.nan if c is None else c for c in v or ()], float)
                good = np.isfinite(x)
                notes = np.mod(np.floor(np.where(good, x, 0.0) * 96), 36).astype(int)
                wave = tones(notes)
                wave[np.repeat(~good, HOP)] = 0
                pcm.append(None if v is None else wave.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(pcm, pa.binary())], ["rec_id", "pcm"])

    used = df.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return used.mapInArrow(run, "rec_id long, pcm binary")


def fingerprinted(df: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", rate: int = RATE) -> DataFrame:
    """rec_id, n_codes, codes (4 bytes each), codes_crc32, of each recording. A last byte that makes no sample is left out."""

    def run(batches):
        for b in parts(batches, "pcm", 1 << 23, 256):
            codes = fingerprints([np.frombuffer(p or b"", "<i2", len(p or b"") // 2) for p in b.column("pcm").to_pylist()], rate)
            raw = [c.astype("<u4").tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [b.column("rec_id"), pa.array([len(c) for c in codes], pa.int32()), pa.array(raw, pa.binary()), pa.array(list(map(zlib.crc32, raw)), pa.int64())],
                ["rec_id", "n_codes", "codes", "codes_crc32"],
            )

    used = df.select(F.col(f"`{id_col}`").cast("long").alias("rec_id"), F.col(f"`{pcm_col}`").alias("pcm"))
    return used.mapInArrow(run, "rec_id long, n_codes int, codes binary, codes_crc32 long")


def _changes(classes: DataFrame) -> DataFrame:
    """class_id, code, at, n: the places where a recording's integer differs from the one before, and how many frames it lasts."""

    def run(batches):
        for b in slices(batches):
            flat = [np.empty((0, 4), np.int64)]
            for i, raw in enumerate(b.column("codes").to_pylist()):
                c = np.frombuffer(raw, "<u4")
                places = np.nonzero(np.concatenate(([True], c[1:] != c[:-1])))[0] if len(c) else np.empty(0, np.int64)
                flat.append(np.column_stack((np.full(len(places), i), c[places].astype(np.int64), places, np.diff(np.append(places, len(c))))))
            who, code, at, n = np.concatenate(flat).T
            yield pa.RecordBatch.from_arrays(
                [b.column("class_id").take(pa.array(who.copy())), pa.array(code.copy()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["class_id", "code", "at", "n"]
            )

    return classes.select("class_id", "codes").mapInArrow(run, "class_id long, code long, at int, n int")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Integers in the overlap if b starts ``offset`` later than a, and differing bits there."""
    x, y = a[max(0, offset) :], b[max(0, -offset) :]
    n = min(len(x), len(y))
    return n, int(np.bitwise_count(x[:n] ^ y[:n]).sum())


def aligned(
    classes: DataFrame, queries: DataFrame, least_votes: int = LEAST_VOTES, most_errors: float = MOST_ERRORS, least_frames: int = LEAST_FRAMES
) -> DataFrame:
    """query_class, class_id, offset, votes, overlap, errors of the classes that align with a query class.

    Every offset with ``least_votes`` equal changes or ``least_frames`` frames
    of such integers is a candidate. Of a pair's candidates whose bits differ
    by ``most_errors`` at most the one with most votes counts; of equal ones
    the nearest to 0, then the smaller.
    """
    places = saved(_changes(classes), "places")
    asked = places.join(queries.select(F.col("class_id")), "class_id", "left_semi").select(F.col("class_id").alias("query_class"), "code", F.col("at").alias("q"), F.col("n").alias("m"))
    met = asked.join(places, "code").where("query_class <> class_id")
    votes = met.groupBy("query_class", "class_id", (F.col("q") - F.col("at")).alias("offset")).agg(
        F.count("*").alias("votes"), F.sum(F.least("n", "m")).alias("frames")
    )
    enough = votes.where((F.col("votes") >= least_votes) | (F.col("frames") >= least_frames))
    tried = enough.groupBy("query_class", "class_id").agg(F.collect_list(F.struct("offset", "votes")).alias("tried"))
    codes = classes.select("class_id", "codes")
    both = tried.join(codes, "class_id").join(codes.select(F.col("class_id").alias("query_class"), F.col("codes").alias("asked")), "query_class")

    def run(batches):
        for b in slices(batches):
            rows = []
            for who, other, x, y, offsets in zip(*(b.column(c).to_pylist() for c in ("query_class", "class_id", "asked", "codes", "tried")), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                for o in sorted(offsets, key=lambda o: (-o["votes"], abs(o["offset"]), o["offset"])):
                    n, errors = bit_errors(x, y, o["offset"])
                    if errors <= most_errors * 32 * n:
                        rows.append((who, other, o["offset"], o["votes"], n, errors))
                        break
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query_class", "class_id", "offset", "votes", "overlap", "errors"]
            )

    return both.mapInArrow(run, "query_class long, class_id long, offset int, votes long, overlap int, errors int")


def matches(df: DataFrame, id_col: str = "rec_id", pcm_col: str = "pcm", every: int = 100, rate: int = RATE) -> DataFrame:
    """rec_id, n_codes, codes_crc32, class_id, alignments of each recording.

    class_id is the least id with the same integers. Recordings whose id is
    divisible by ``every`` are the queries; alignments (class_id, offset in
    frames, votes, overlap, errors) stand with the class of a query, on the
    row of its least id, and are null elsewhere. Too short, null and empty
    recordings have no integers, no class and no alignments; long ones are
    fingerprinted by stretches; a last odd byte is no sample; null ids come back without a class; repeated rows repeat. An empty table gives no rows.
    """
    every_one = saved(fingerprinted(df, id_col, pcm_col, rate), "codes")
    named = every_one.where("rec_id is not null and n_codes > 0")
    asks = F.max(F.col("rec_id") % every == 0).alias("asks")
    classes = saved(named.groupBy("codes").agg(F.min("rec_id").alias("class_id"), asks), "classes")
    # An id with several recordings can stand for several classes; a class then needs more than the id.
    found = aligned(classes, classes.where("asks"))
    held = found.groupBy(F.col("query_class").alias("class_id")).agg(
        F.array_sort(F.collect_list(F.struct("class_id", "offset", "votes", "overlap", "errors"))).alias("alignments")
    )
    rows = every_one.join(classes.select("codes", "class_id"), "codes", "left").join(held, "class_id", "left")
    own = F.when(F.col("rec_id").isNotNull(), F.col("class_id"))
    return rows.select("rec_id", "n_codes", "codes_crc32", own.alias("class_id"), F.when(F.col("rec_id") == F.col("class_id"), F.col("alignments")).alias("alignments"))
