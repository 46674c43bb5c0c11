"""Waveform operators as Arrow functions on array<float> columns, 16 kHz."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gatelight.functions.vector import rms
from gatelight.operators.windows import sliding


def _each(kind: str, f):
    """A pandas UDF that applies f to each waveform; nulls stay."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(np.asarray(x, np.float32)))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def peak_normalize(peak: float = 0.95, epsilon: float = 0.0):
    """Scaled so that the peak, plus epsilon, is at `peak`; silence stays."""

    def f(x):
        top = np.abs(x).max(initial=0) + epsilon
        return x if top < 1e-8 else (x * (peak / top)).astype(np.float32)

    return _each("array<float>", f)


def truncate(n: int):
    return _each("array<float>", lambda x: x[:n])


def loudest(n: int):
    """The window of n samples with the most energy, at steps of a quarter; the end is tried too."""

    def f(x):
        if len(x) <= n:
            return x
        best = _loudest_at(x, n)
        return x[best : best + n]

    return _each("array<float>", f)


def frame_energies(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    if len(x) < frame:
        return np.sqrt([np.mean(x.astype(np.float64) ** 2)]) if len(x) else np.zeros(0)
    power = np.concatenate(([0.0], np.cumsum(x.astype(np.float64) ** 2)))
    at = np.arange(0, len(x) - frame + 1, hop)
    return np.sqrt(np.maximum(power[at + frame] - power[at], 0) / frame)


def active_frames(e: np.ndarray) -> np.ndarray:
    """Louder than a fifth of the way from the 20th to the 95th percentile."""
    if not len(e):
        return np.zeros(0, bool)
    lo, hi = np.percentile(e, 20), np.percentile(e, 95)
    return e > max(lo + 0.2 * (hi - lo), 1e-5)


def speech_segments(frame: int = 400, hop: int = 160, gap: int = 20, least: int = 10):
    """array<struct<start, end>>: runs of active frames, gaps of up to `gap` closed, short ones dropped."""

    def f(x):
        on = np.flatnonzero(active_frames(frame_energies(x, frame, hop)))
        if not len(on):
            return []
        runs = np.split(on, np.flatnonzero(np.diff(on) > gap) + 1)
        return [{"start": int(r[0] * hop), "end": int(min(len(x), r[-1] * hop + frame))} for r in runs if len(r) >= least]

    return _each("array<struct<start:long,end:long>>", f)


def crop(start, end, n, pad: int):
    """(start, end) widened by pad samples within 0 and n, as columns."""
    return F.struct(F.greatest(start - pad, F.lit(0)).alias("start"), F.least(end + pad, n).alias("end"))


def vad_crop(pad: int = 1280):
    """The stretch from the first to the last active frame, widened; the whole if nothing is active."""

    def f(x):
        on = np.flatnonzero(active_frames(frame_energies(x, 400, 160)))
        return x if not len(on) else x[max(0, on[0] * 160 - pad) : on[-1] * 160 + 400 + pad]

    return _each("array<float>", f)


# Half width in zero crossings and Kaiser beta of each resampling method (null: Hann).
KERNELS = {"poly": (10, 5.0), "soxr_hq": (32, 10.0), "kaiser_best": (50, 12.98), "kaiser_fast": (24, 8.55), "hann": (16, None)}


def resampled(x: np.ndarray, source: int, target: int, method: str = "hann") -> np.ndarray:
    """Band-limited resampling with the kernel of the method; unknown methods raise."""
    crossings, beta = KERNELS[method]
    if source == target or not len(x):
        return x
    ratio = target / source
    cut = min(1.0, ratio)
    half = int(np.ceil(crossings / cut))
    out = np.empty(int(np.ceil(len(x) * ratio)), np.float32)
    reach = np.arange(-half + 1, half + 1)
    for begin in range(0, len(out), 1 << 14):  # blocks of output samples bound the memory
        t = np.arange(begin, min(begin + (1 << 14), len(out))) / ratio
        taps = np.floor(t).astype(np.int64)[:, None] + reach
        d = np.clip((t[:, None] - taps) / half, -1, 1)
        shape = 0.5 + 0.5 * np.cos(np.pi * d) if beta is None else np.i0(beta * np.sqrt(1 - d * d)) / np.i0(beta)
        known = np.where((taps >= 0) & (taps < len(x)), x[np.clip(taps, 0, len(x) - 1)], 0)
        out[begin : begin + len(t)] = (cut * np.sinc(cut * (t[:, None] - taps)) * shape * known).sum(1)
    return out


def resample(source: int, target: int, method: str = "hann"):
    if method not in KERNELS:
        raise ValueError(f"unknown method {method}")
    return _each("array<float>", lambda x: resampled(x, source, target, method))


def match_rms(x: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Scaled to the other's loudness by a factor of 1/8 to 8, peaks at 0.99."""
    r = lambda v: np.sqrt(np.mean(np.square(v, dtype=np.float64)) + 1e-12)
    y = x * np.clip(r(like) / r(x), 0.125, 8.0)
    top = np.abs(y).max(initial=0)
    return (y * min(1.0, 0.99 / top) if top else y).astype(np.float32)


@F.pandas_udf(ArrayType(FloatType()))
def rms_match(x: pd.Series, like: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else match_rms(np.asarray(a), np.asarray(b)) for a, b in zip(x, like, strict=True)])


def speech_ratio():
    return _each("double", lambda x: float(active_frames(frame_energies(x, 400, 160)).mean()) if len(x) >= 400 else 0.0)


def two_tones(seconds: float = 2.0, rate: int = 16000) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return (0.4 * np.sin(2 * np.pi * 220 * t) + 0.4 * np.sin(2 * np.pi * 440 * t)).astype(np.float32)


def valid(x: np.ndarray) -> bool:
    """Finite, not empty, not silent."""
    return bool(len(x) and np.isfinite(x).all() and np.sqrt(np.mean(np.square(x, dtype=np.float64))) > 1e-4)


def stream_names(depth: int) -> list[str]:
    """mix, then the two of the first separation, then the two of each of these."""
    first = ["d1_spk1", "d1_spk2"] if depth >= 1 else []
    return ["mix", *first, *(f"d2_{n[3:]}_{x}" for n in first for x in "ab")] if depth >= 2 else ["mix", *first]


VAD_FIELDS = "struct<wav:array<float>,reason:string,cropped:boolean,begin:long,finish:long,speech_frames:long,orig_n:long,out_n:long>"


def cropped_speech(x: np.ndarray, rate: int = 16000, frame_ms: float = 20.0, pad_ms: float = 100.0, share: float = 0.12, least_ms: float = 200.0, most_seconds: float = 4.0) -> dict:
    """The stretch of speech by energy, with what was found.

    Frames over noise + share * (peak - noise) are speech, noise and peak being the 20th and 95th percentiles. Too few
    samples or frames, no speech or too little of it give the whole waveform with the reason; flat energy counts as speech.
    """
    n, frame = len(x), max(1, int(rate * frame_ms / 1000))
    out = {"wav": x, "reason": None, "cropped": False, "begin": 0, "finish": n, "speech_frames": 0, "orig_n": n, "out_n": n}
    if n < int(0.05 * rate):
        return {**out, "reason": "too_short"}
    count = n // frame
    if count < 3:
        return {**out, "reason": "few_frames"}
    energy = np.square(x[: count * frame], dtype=np.float64).reshape(count, frame).mean(1)
    noise, peak = np.percentile(energy, [20, 95])
    if peak <= 1.5 * noise:
        out["reason"] = "flat_energy"
    else:
        on = np.flatnonzero(energy >= noise + (peak - noise) * share)
        if not len(on):
            return {**out, "reason": "no_speech"}
        pad = max(0, int(pad_ms / frame_ms))
        out.update(begin=int(max(0, on[0] - pad) * frame), finish=int(min(n, min(count, on[-1] + 1 + pad) * frame)), speech_frames=len(on))
    if out["finish"] - out["begin"] < int(rate * least_ms / 1000):
        return {**out, "reason": "speech_too_short", "begin": 0, "finish": n}
    speech, most = x[out["begin"] : out["finish"]], int(most_seconds * rate)
    if 0 < most < len(speech):
        at = _loudest_at(speech, most)
        out.update(begin=out["begin"] + at, finish=out["begin"] + at + most)
        speech = speech[at : at + most]
    return {**out, "wav": speech, "cropped": True, "out_n": len(speech)}


def _loudest_at(x: np.ndarray, n: int) -> int:
    power = np.concatenate(([0.0], np.cumsum(x.astype(np.float64) ** 2)))
    starts = np.append(np.arange(0, len(x) - n + 1, max(1, n // 4)), len(x) - n)
    return int(starts[np.argmax(power[starts + n] - power[starts])])


def vad_struct(**options):
    """`cropped_speech` as a column function."""

    def run(s: pd.Series) -> pd.DataFrame:
        names = [f.split(":")[0] for f in VAD_FIELDS[len("struct<") : -1].split(",")]
        return pd.DataFrame([dict.fromkeys(names) if x is None else cropped_speech(np.asarray(x, np.float32), **options) for x in s], columns=names)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, VAD_FIELDS[len("struct<") : -1].replace(":", " "))


def command_windows(wav, mode: str = "slide", win: int = 12800, hop: int = 6400, least: int = 5600):
    """array<struct<start, end>> of a waveform column: the whole (off), speech segments (energy) or sliding windows."""
    low = (mode or "slide").strip().lower()
    n = F.size(wav)
    if low in ("off", "none", "0", ""):
        return F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return speech_segments()(wav) if low in ("energy", "vad", "seg") else sliding(n, win, hop, least)


def audible(spans, wav, least: float = 1e-4):
    """The spans whose loudness reaches `least`; all of them if none does, and a lone one always."""
    part = lambda w: F.slice(wav, w["start"].cast("int") + 1, F.greatest((w["end"] - w["start"]).cast("int"), F.lit(1)))
    kept = F.filter(spans, lambda w: rms(F.transform(part(w), lambda x: x.cast("double"))) >= least)
    return F.when((F.size(spans) > 1) & (F.size(kept) > 0), kept).otherwise(spans)


def filter_bank(rate: int, n_fft: int, n_mels: int, low: float = 20.0) -> np.ndarray:
    """Triangles evenly spaced in mel (1127 ln(1 + f / 700)), n_mels by n_fft / 2 + 1."""
    mel = lambda f: 1127.0 * np.log1p(f / 700.0)
    edges = np.linspace(mel(low), mel(rate / 2), n_mels + 2)
    at = mel(np.arange(n_fft // 2 + 1) * rate / n_fft)
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int = 16000, n_mels: int = 80) -> np.ndarray:
    """Log mel energies of 25 ms Hamming frames every 10 ms (no dither, 0.97 pre-emphasis), less their mean over time."""
    size, hop = rate // 40, rate // 100
    if len(x) < size:
        return np.zeros((0, n_mels), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x.astype(np.float64) * 32768, size)[::hop]
    frames = frames - frames.mean(1, keepdims=True)
    frames = frames - 0.97 * np.concatenate([frames[:, :1], frames[:, :-1]], 1)
    n_fft = 1 << (size - 1).bit_length()
    power = np.abs(np.fft.rfft(frames * np.hamming(size), n_fft)) ** 2
    got = np.log(np.maximum(power @ filter_bank(rate, n_fft, n_mels).T, np.finfo(np.float32).eps))
    return (got - got.mean(0)).astype(np.float32)


def features(n_mels: int = 80):
    return _each("array<array<float>>", lambda x: log_mel(x, n_mels=n_mels).tolist())


def overlap_add(x: np.ndarray, f, chunk: int) -> np.ndarray:
    """f over chunks at steps of half their length, joined by Hann weights; up to one chunk is one call.

    A last chunk of under a quarter is left to the one before; samples that no weight reaches are 0.
    """
    if len(x) <= chunk:
        return np.asarray(f(x), np.float32)
    out, weight = np.zeros(len(x)), np.zeros(len(x))
    for begin in range(0, len(x), max(1, chunk // 2)):
        part = x[begin : begin + chunk]
        if len(part) < chunk // 4:
            break
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(part)) / len(part))
        out[begin : begin + len(part)] += np.asarray(f(np.pad(part, (0, chunk - len(part)))))[: len(part)] * window
        weight[begin : begin + len(part)] += window
    return (out / np.maximum(weight, 1e-8)).astype(np.float32)
