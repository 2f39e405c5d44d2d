"""Scalar expressions on columns: normalisation, pitch, registers, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

# Names of pitch classes.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    """num / den, and ``default`` where den isn't above 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(default))


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then(x)`` with x computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, by exact products of split halves and an exact sum."""

    def halves(x: Column) -> Column:
        return let(x * 134217729.0, lambda t: let(t - (t - x), lambda hi: F.struct(hi.alias("hi"), (x - hi).alias("lo"))))

    def add(p: Column, x: Column, y: Column) -> Column:
        lost = ((x["hi"] * y["hi"] - p) + x["hi"] * y["lo"] + x["lo"] * y["hi"]) + x["lo"] * y["lo"]
        return let(p + c, lambda s: let(s - p, lambda t: s + F.nanvl(((p - (s - t)) + (c - t)) + lost, F.lit(0.0))))

    return let(a * b, lambda p: let(halves(a), lambda x: let(halves(b), lambda y: add(p, x, y))))


def quantile(value: Column | str, q: float) -> Column:
    """Exact quantile of a group, an aggregate; null for a group without values.

    Between two values it is lo * (1 - part) + hi * part with the first product
    unrounded, as DuckDB's quantile_cont has it, to the last bit: F.percentile
    rounds it, which shows where values are compared with shares of a quantile.
    """

    def pick(vs: Column) -> Column:
        at = (F.size(vs) - 1) * F.lit(q)
        lo, hi, part = F.get(vs, F.floor(at).cast("int")), F.get(vs, F.ceil(at).cast("int")), at - F.floor(at)
        between = let(lo, lambda x: let(hi, lambda y: let(part, lambda t: _fused(x, F.lit(1.0) - t, y * t))))
        return F.when(part == 0, lo).otherwise(between)

    return let(F.sort_array(F.collect_list(F.col(value) if isinstance(value, str) else value)), pick)


def clamp01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def hz_to_midi(hz: Column) -> Column:
    return F.lit(69.0) + F.lit(12.0) * F.log2(F.greatest(hz, F.lit(1e-6)) / 440.0)


def midi_to_hz(midi: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - 69.0) / 12.0)


def pitch_class(midi: Column) -> Column:
    """Half-even rounded MIDI modulo 12, never negative."""
    return F.pmod(F.bround(midi).cast("int"), F.lit(12))


def note_name(midi: Column) -> Column:
    n = F.bround(midi).cast("int")
    return F.concat(F.element_at(F.array(*map(F.lit, NOTE_NAMES)), F.pmod(n, F.lit(12)) + 1), (F.floor(n / 12) - 1).cast("string"))


def octave_distance(a: Column, b: Column) -> Column:
    """Distance of two pitch classes around the octave."""
    d = F.abs(a - b)
    return F.least(d, F.lit(12) - d)


def fold_register(midi: Column, lo: float = 41.0, hi: float = 65.0) -> Column:
    """Moves a pitch by whole octaves until it is within the register."""
    up = midi + F.lit(12.0) * F.ceil((F.lit(lo) - midi) / 12.0)
    down = midi - F.lit(12.0) * F.ceil((midi - F.lit(hi)) / 12.0)
    return F.when(midi < lo, up).when(midi > hi, down).otherwise(midi)


def smooth_gate(x: Column, threshold: float, knee: float) -> Column:
    t = clamp01((x - threshold) / knee)
    return F.when(x <= threshold, F.lit(0.0)).otherwise(t * t * (F.lit(3.0) - F.lit(2.0) * t))


def section_label(i: Column) -> Column:
    """A..Z, AA..ZZ, AAA.., by bijective base 26 of a number from 0 (of up to 14 letters); null for null."""
    state = F.struct(F.lit("").alias("s"), (i.cast("long") + 1).alias("n"))
    step = lambda acc, k: F.when(acc["n"] > 0, F.struct(F.concat(F.char(F.lit(65) + (acc["n"] - 1) % 26), acc["s"]).alias("s"), F.floor((acc["n"] - 1) / 26).alias("n"))).otherwise(acc)
    return F.when(i.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(14)), state, step, lambda acc: acc["s"]))


def first_seen_index(label: Column, position: Column, over: WindowSpec, size: int) -> Column:
    """A label's colour by first appearance: how many labels of the window began before it, modulo a palette's size.

    position: the earliest position of the label, as ``F.min(..).over(label)`` gives it.
    """
    return (F.dense_rank().over(over.orderBy(position, label)) - 1) % size


def label_index(label: Column, size: int) -> Column:
    """Base-26 value of a label modulo a palette's size."""
    value = F.aggregate(F.split(label, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))
    return (value - 1) % size


def band_of(kick: Column, snare: Column, hh: Column) -> Column:
    """The component of the largest band energy; the first of equals."""
    most = F.greatest(kick, snare, hh)
    return F.when(kick == most, "kick").when(snare == most, "snare").otherwise("hh")


def energy_word(first_quarter: Column, last_quarter: Column, mean: Column) -> Column:
    d = last_quarter - first_quarter
    return F.when(d > 0.12, "rising").when(d < -0.12, "falling").when(mean < 0.35, "low").when(mean > 0.65, "high").otherwise("mid")


def flags(*rules: tuple[str, Column]) -> Column:
    """Sorted set of the names whose condition holds."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))))


def calibration_applies(offset: Column, corr: Column, gain: Column) -> Column:
    """Whether a measured offset between lyrics and signal is worth applying."""
    size = F.abs(offset)
    return (size >= 0.03) & (corr >= 0.08) & ((gain >= 0.01) | ((size >= 0.10) & (gain >= 0.005)))


def shifted(start: Column, end: Column, offset: Column) -> tuple[Column, Column]:
    """Times moved by an offset: start not below 0, end not below start, 6 decimals."""
    s = F.round(F.greatest(F.lit(0.0), start + offset), 6)
    return s, F.greatest(s, F.round(end + offset, 6))


# Classes of a word's first sound by its first two letters, else by its first; and each class's lead-in in seconds.
SOUND_OF_TWO = {
    "kn": "nasal", "gn": "nasal", "mn": "nasal", "wr": "approximant", "wh": "approximant", "th": "fricative", "sh": "fricative", "ps": "vowel", "pn": "vowel", "pt": "vowel", "gh": "vowel", "ch": "affricate",
    "ce": "fricative", "ci": "fricative", "cy": "fricative",
}
SOUND_OF_ONE = {"plosive": "bdgkptqc", "affricate": "j", "fricative": "fhszx", "nasal": "mn", "approximant": "lrwy", "vowel": "aeiou"}
LEAD_IN = {"plosive": 0.055, "affricate": 0.045, "fricative": 0.025, "nasal": 0.020, "approximant": 0.020, "vowel": 0.005, "unknown": 0.040}
