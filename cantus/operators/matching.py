"""Greedy one-to-one matching of two kinds of events in one pass over time-ordered rows.

References are taken in time order, and each takes its nearest free detection
within a tolerance; of equals the earlier in order.  A pass holds only what
lies within the tolerance of the reference at hand, and its work grows with the
events, not with the square of those that lie close together.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Line:
    """Free detections of one pitch: those up to the reference at hand, nearest last, and those behind it, nearest first."""

    __slots__ = ("after", "before")

    def __init__(self) -> None:
        self.before: deque = deque()  # (t, numbers of the detections at t in order)
        self.after: deque = deque()

    def move(self, r: float, tol: float) -> bool:
        """Makes ``r`` the reference at hand; whether anything is left."""
        before, after = self.before, self.after
        while after and after[0][0] <= r:
            t, i = after.popleft()
            if before and before[-1][0] == t:
                before[-1][1].append(i)
            else:
                before.append((t, deque((i,))))
        while before and not r - before[0][0] <= tol:
            before.popleft()
        return bool(before or after)

    def best(self, r: float, tol: float) -> tuple[float, int, int] | None:
        """(distance, number, place in ``before`` or -1) of the best detection."""
        found = None
        if self.before:
            k = len(self.before) - 1
            e = r - self.before[k][0]
            while k and r - self.before[k - 1][0] == e:  # another time at the same rounded distance
                k -= 1
            found = (e, self.before[k][1][0], k)
        if self.after:
            e = self.after[0][0] - r
            if e <= tol and (found is None or e < found[0]):
                found = (e, self.after[0][1], -1)
        return found

    def take(self, place: int) -> None:
        if place < 0:
            self.after.popleft()
        else:
            numbers = self.before[place][1]
            numbers.popleft()
            if not numbers:
                del self.before[place]


def _class_distance(d: float, r: float) -> float:
    x = abs(d - r)
    x = (math.floor(x) + (x - math.floor(x) >= 0.5)) % 12
    return min(x, 12 - x)


#: Whether pitches ``d`` and ``r`` match, by variant; None: pitch doesn't count.
FITS: dict[str, Callable[[float, float], bool] | None] = {"onset": None, "pitch": lambda d, r: abs(d - r) <= 1.0, "class": lambda d, r: _class_distance(d, r) <= 1}


class Matcher:
    """Matches of one variant in one track: their number, those within a semitone, and the sum of distances."""

    def __init__(self, variant: str, tol: float) -> None:
        self.fits, self.tol = FITS[variant], tol
        self.lines: dict[float | None, Line] = {}
        self.midi: dict[int, float | None] = {}  # of free detections; without pitch only
        self.known: dict[float, list[float]] = {}  # a reference's pitch -> pitches that fit
        self.n = self.hits = 0
        self.error = 0.0

    def detection(self, t: float, i: int, midi: float | None) -> None:
        if self.fits:
            if midi is None or not math.isfinite(midi):
                return
            key = midi
        else:
            key, self.midi[i] = None, midi
        if key not in self.lines:
            self.lines[key] = Line()
            self.known.clear()
        self.lines[key].after.append((t, i))

    def reference(self, r: float, midi: float | None) -> None:
        if self.fits is None:
            keys = (None,)
        elif midi is None or not math.isfinite(midi):
            return
        elif (keys := self.known.get(midi)) is None:
            keys = self.known[midi] = [k for k in self.lines if self.fits(k, midi)]
        best = line = where = None
        for k in keys:
            x = self.lines.get(k)
            if x is not None and x.move(r, self.tol):
                b = x.best(r, self.tol)
                if b is not None and (best is None or b[:2] < best[:2]):
                    best, line, where = b, x, k
        if best is None:
            return
        line.take(best[2])
        self.n += 1
        self.error += best[0]
        d = self.midi.pop(best[1], None) if where is None else where
        self.hits += d is not None and midi is not None and abs(d - midi) <= 1.0

    def sweep(self, r: float) -> None:
        """Lets go of all that no reference from ``r`` on can reach."""
        for k in list(self.lines):
            if not self.lines[k].move(r, self.tol):
                del self.lines[k]
                self.known.clear()
        if self.fits is None:
            line = self.lines.get(None)
            held = {i for _, numbers in line.before for i in numbers} | {i for _, i in line.after} if line else set()
            self.midi = {i: m for i, m in self.midi.items() if i in held}


class Track:
    """The matchers of one track, fed with its events in time order."""

    def __init__(self, variants: list[str], tol: float) -> None:
        self.tol, self.matchers = tol, [Matcher(v, tol) for v in variants]
        self.waiting: deque = deque()  # references that later detections may still reach
        self.n_det = self.n_ref = 0

    SWEEP = 4096

    def add(self, t: float | None, is_ref: bool, midi: float | None) -> None:
        self.n_ref, self.n_det = self.n_ref + is_ref, self.n_det + (not is_ref)
        if t is None or not math.isfinite(t):
            return
        while self.waiting and not t - self.waiting[0][0] <= self.tol:
            self._settle()
        if is_ref:
            self.waiting.append((t, midi))
        else:
            for m in self.matchers:
                m.detection(t, self.n_det, midi)
        if (self.n_det + self.n_ref) % self.SWEEP == 0:
            for m in self.matchers:
                m.sweep(self.waiting[0][0] if self.waiting else t)

    def _settle(self) -> None:
        r, midi = self.waiting.popleft()
        for m in self.matchers:
            m.reference(r, midi)

    def row(self) -> tuple:
        while self.waiting:
            self._settle()
        return (self.n_ref, self.n_det, *[x for m in self.matchers for x in (m.n, m.hits, m.error)])


class Onsets:
    """Matches of one track by time alone, fed with stretches of its events in time order.

    A reference is settled once a detection behind it is free, so only such
    references wait that no detection has followed yet, and of detections the
    free ones within the tolerance are held, as plain doubles.
    """

    def __init__(self, tol: float) -> None:
        self.tol, self.n = tol, 0
        self.n_det = self.n_ref = 0
        self.refs, self.after, self.before = array("d"), array("d"), array("d")  # not settled; detections behind the reference at hand; free ones up to it

    def add(self, t: np.ndarray, is_ref: np.ndarray) -> None:
        refs = int(np.count_nonzero(is_ref))
        self.n_ref, self.n_det = self.n_ref + refs, self.n_det + len(t) - refs
        known = np.isfinite(t)
        t, is_ref = t[known].astype("f8", copy=False), is_ref[known]
        if len(t):
            self.refs.frombytes(t[is_ref].tobytes())
            self.after.frombytes(t[~is_ref].tobytes())
            self._settle(float(t[-1]))

    def _settle(self, seen: float) -> None:
        """Settles the references whose detections are all there, where events up to ``seen`` are."""
        tol, before, after, refs, j, n = self.tol, self.before, self.after, self.refs, 0, 0
        end, done = len(after), 0
        for r in refs:
            while j < end and after[j] <= r:
                before.append(after[j])
                j += 1
            if j == end and seen - r <= tol:
                break
            done += 1
            e = r - before[-1] if before else math.inf
            if j < end and (d := after[j] - r) < e:
                if d <= tol:
                    j, n = j + 1, n + 1
            elif e <= tol:
                if r - math.nextafter(before[-1], -math.inf) == e:  # other times may be at the same rounded distance
                    before.pop(bisect_left(before, -e, key=lambda t: t - r))  # noqa: B023
                else:
                    before.pop()
                n += 1
        self.n += n
        del refs[:done], after[:j]
        near = refs[0] if refs else seen
        del before[: bisect_left(before, -tol, key=lambda t: t - near)]

    def row(self) -> tuple[int, int, int]:
        self._settle(math.inf)
        return self.n_ref, self.n_det, self.n


def onset_counts(events: DataFrame, tol: float) -> DataFrame:
    """track, n_ref, n_det and matched of each track, by time alone.

    events: track, t, is_ref.  Which of the detections of one time is taken is
    the same for the counts, so events are ordered by time only.
    """
    kind = events.schema["track"].dataType.simpleString()
    names = ["track", "n_ref", "n_det", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Onsets | None = None
        track = arrow = None
        done: list[tuple] = []  # of tracks that ended in the batch at hand

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*done, strict=True), [arrow, *[pa.int64()] * 3], strict=True)], names)
            done.clear()
            return rows

        for b in batches:
            runs = pc.run_end_encode(b.column("track"))
            arrow = b.schema.field("track").type
            t, is_ref = (b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "is_ref"))
            start = 0
            for key, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if at is None or key != track:
                    if at is not None:
                        done.append((track, *at.row()))
                    at, track = Onsets(tol), key
                at.add(t[start:stop], is_ref[start:stop])
                start = stop
            if done:
                yield out()
        if at is not None:
            done.append((track, *at.row()))
            yield out()

    ordered = events.select("track", F.col("t").cast("double").alias("t"), "is_ref").repartition("track").sortWithinPartitions("track", "t")
    return ordered.mapInArrow(run, f"track {kind}, n_ref long, n_det long, matched long")


def match_counts(events: DataFrame, variants: list[str], tol: float) -> DataFrame:
    """track, n_ref, n_det and for each variant matched_, pitch_hits_ and error_ of each track.

    events: track, t, note_id, midi (null if there is none), is_ref.  Events of
    one time are taken in the order of note_id and midi.
    """
    kind = events.schema["track"].dataType.simpleString()
    names = ["track", "n_ref", "n_det", *[f"{c}_{v}" for v in variants for c in ("matched", "pitch_hits", "error")]]
    types = [pa.int64(), pa.int64()] + [x for _ in variants for x in (pa.int64(), pa.int64(), pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: Track | None = None
        track = arrow = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([track], arrow), *[pa.array([x], y) for x, y in zip(at.row(), types, strict=True)]], names)

        for b in batches:
            arrow = b.schema.field("track").type
            for key, t, is_ref, midi in zip(*[b.column(c).to_pylist() for c in ("track", "t", "is_ref", "midi")], strict=True):
                if at is None or key != track:
                    if at is not None:
                        yield out()
                    at, track = Track(variants, tol), key
                at.add(t, is_ref, midi)
        if at is not None:
            yield out()

    ordered = events.select("track", "t", "note_id", "midi", "is_ref").repartition("track").sortWithinPartitions("track", "t", "note_id", "midi")
    fields = ", ".join(f"{n} {'double' if n.startswith('error') else 'long'}" for n in names[1:])
    return ordered.select("track", "t", "midi", "is_ref").mapInArrow(run, f"track {kind}, {fields}")


def events_of(det: DataFrame, ref: DataFrame, t: str, *more: str) -> DataFrame:
    """Both sides as one table for ``match_counts``."""
    none = {"note_id": F.lit(None).cast("long"), "midi": F.lit(None).cast("double")}
    pick = lambda df, side: df.select("track", F.col(t).alias("t"), *[(F.col(c) if c in more else x).alias(c) for c, x in none.items()], F.lit(side).alias("is_ref"))
    return pick(det, False).union(pick(ref, True))
