"""Where models come in: protocols, a registry with aliases, and deterministic stand-ins.

A model is built once in each Python worker and given whole Arrow batches; rows that need none are
filtered before, since a Python function in a conditional runs on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions import text as X

# Names of separation back ends and what they stand for.
BACKENDS = {
    "ps4": ["ps4", "ps4_bsrnn", "bsrnn"],
    "wesep_bsrnn": ["wesep", "wesep_bsrnn", "wesep_bsrnn_ecapa"],
    "sep_route": ["sep_route", "mossformer", "route", "sep"],
    "cond_tasnet": ["cond_tasnet", "condtasnet", "tasnet", "cond-tasnet"],
    "mix": ["mix", "passthrough", "mix_passthrough", "cmd", "none"],
}
# Arms and the depth of separation they have.
ARM_DEPTH = {"no_sep": 0, "mix": 0, "sep_once": 1, "once": 1, "d1": 1, "sep_multi": 2, "multi": 2, "d2": 2}


class Encoder(Protocol):
    def embed(self, wavs: list[np.ndarray]) -> list[np.ndarray]: ...


class Separator(Protocol):
    def separate(self, wav: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class Recognizer(Protocol):
    def transcribe(self, wavs: list[np.ndarray], language: str | None, context: str | None) -> list[str]: ...


class FakeEncoder:
    """Band energies of the spectrum, as an embedding."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def embed(self, wavs):
        return [np.array([np.sqrt(b.sum()) for b in np.array_split(np.abs(np.fft.rfft(w, 2048)) ** 2, self.dim)], np.float32) for w in wavs]


class FakeSeparator:
    """Low and high half of the spectrum."""

    def separate(self, wav):
        f = np.fft.rfft(wav)
        cut = max(1, int(len(f) * 330 / 8000))
        low = np.fft.irfft(np.where(np.arange(len(f)) < cut, f, 0), len(wav))
        return low.astype(np.float32), (wav - low).astype(np.float32)


class FakeRecognizer:
    def transcribe(self, wavs, language, context):
        return [f"{language or 'auto'}:{len(w)}" for w in wavs]


ENCODERS: dict[str, Callable[[], Encoder]] = {"fake": FakeEncoder}


def backend(name: Column) -> Column:
    """Canonical name of a separation back end; none given is ps4, unknown ones raise."""
    low = F.lower(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("ps4"))))
    out = None
    for canonical, names in BACKENDS.items():
        out = F.when(low.isin(names), canonical) if out is None else out.when(low.isin(names), canonical)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown back end: "), low)))


def arm_depth(arm: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ARM_DEPTH.items() for x in kv]), F.lower(arm))


def embed(factory: Callable[[], Encoder]):
    """A column function from waveforms to embeddings."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            yield pd.Series(model.embed([np.asarray(x, np.float32) for x in s]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def separate(df: DataFrame, factory: Callable[[], Separator], key: str, wav: str, depth: int) -> DataFrame:
    """(key, stream, wav): the mix and its separations down to `depth`."""

    def run(batches):
        model = factory()
        for pdf in batches:
            out = []
            for k, x in zip(pdf[key], pdf[wav], strict=True):
                x = np.asarray(x, np.float32)
                out.append((k, "mix", x))
                level = []
                if depth >= 1:
                    level = [(f"d1_spk{i + 1}", y) for i, y in enumerate(model.separate(x))]
                    out += [(k, n, y) for n, y in level]
                if depth >= 2:
                    out += [(k, f"d2_{n[3:]}_{c}", z) for n, y in level for c, z in zip("ab", model.separate(y), strict=True)]
            yield pd.DataFrame(out, columns=[key, "stream", wav])

    return df.select(key, wav).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, stream string, {wav} array<float>")


def recognize(df: DataFrame, factory: Callable[[], Recognizer], language: str, context: str, wav: str) -> DataFrame:
    """`df` without wav, with asr_text and error: equal (language, context) rows of a batch go together,
    and one by one if the batch fails."""
    keep = [c for c in df.columns if c != wav]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != wav)

    def run(batches):
        model = factory()
        for pdf in batches:
            text, error = pd.Series(None, pdf.index, object), pd.Series(None, pdf.index, object)
            for (lang, ctx), part in pdf.groupby([pdf[language].fillna(""), pdf[context].fillna("")]):
                wavs = [np.asarray(x, np.float32) for x in part[wav]]
                try:
                    text.loc[part.index] = model.transcribe(wavs, lang or None, ctx or None)
                except Exception:
                    for i, w in zip(part.index, wavs, strict=True):
                        try:
                            text.loc[i] = model.transcribe([w], lang or None, ctx or None)[0]
                        except Exception as e:  # the row's own record
                            error.loc[i] = str(e)
            yield pdf[keep].assign(asr_text=text, error=error)

    return df.mapInPandas(run, schema + ", asr_text string, error string")


def gated(df: DataFrame, gate: Column, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f on the rows that pass the gate, the others as they are with nulls."""
    return f(df.where(gate)).unionByName(df.where(~F.coalesce(gate, F.lit(False))), allowMissingColumns=True)


def context_of(explicit: Column, hotwords: Column, domain: Column, wake: Column) -> Column:
    full = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(full(explicit), full(hotwords), full(domain), full(wake))


# Names of the speaker encoders with their aliases.
ENCODER_NAMES = {
    "eres2netv2": ["eres2netv2", "eres", "eres2net"], "campplus": ["campplus", "cam++", "campplus_zh"],
    "vblink2": ["vblink2", "vblink", "vblinkp", "samresnet34"], "resnet34": ["resnet34", "resnet34_lm", "wespeaker"],
}


def encoder(name: str, known: dict[str, Callable[[], Encoder]] | None = None) -> Callable[[], Encoder]:
    """The factory registered for a name or an alias of it; the neural back ends are the caller's to register."""
    known, low = ENCODERS if known is None else known, (name or "eres2netv2").strip().lower()
    for canonical in [low, *(c for c, names in ENCODER_NAMES.items() if low in names)]:
        if canonical in known:
            return known[canonical]
    raise KeyError(f"no encoder registered for {name!r}")


class Isolator(Protocol):
    """Takes the voice of an enrolment out of a mix."""

    def isolate(self, mix: np.ndarray, enrol: np.ndarray) -> np.ndarray: ...


class MixIsolator:
    """The mix as it is, at a peak of 0.95."""

    def isolate(self, mix, enrol):
        top = np.abs(mix).max(initial=0)
        return mix if top < 1e-8 else (mix * (0.95 / top)).astype(np.float32)


class RouteIsolator:
    """The separated voice whose embedding is nearest the enrolment's, the first of equals; a silent mix stays."""

    def __init__(self, encoder: Encoder, separator: Separator):
        self.encoder, self.separator = encoder, separator

    def isolate(self, mix, enrol):
        if not len(mix):
            return mix
        voices = list(self.separator.separate(mix))
        e, *found = (np.asarray(v, np.float64) for v in self.encoder.embed([enrol, *voices]))
        sims = [float(e @ v / ((np.linalg.norm(e) + 1e-8) * (np.linalg.norm(v) + 1e-8))) for v in found]
        return voices[int(np.argmax(sims))]


def shortened(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tries: int = 3) -> np.ndarray:
    """f(x); out of memory, f of half the length, and so on; the last failure is raised."""
    for left in range(tries, -1, -1):
        try:
            return f(x)
        except MemoryError:
            if not left or len(x) < 2:
                raise
            x = x[: len(x) // 2]
    raise AssertionError


def isolate(df: DataFrame, factory: Callable[[], Isolator], mix: str, enrol: str, out: str = "isolated") -> DataFrame:
    """`df` with `out`, the isolated waveform, and isolate_error, null where it worked; one model for each task."""
    extra = f"{out} array<float>, isolate_error string"

    def run(batches):
        model = factory()
        for pdf in batches:
            wavs, errors = [], []
            for m, e in zip(pdf[mix], pdf[enrol], strict=True):
                try:
                    e32 = np.asarray(e, np.float32)
                    wavs.append(shortened(lambda x, e32=e32: model.isolate(x, e32), np.asarray(m, np.float32)))
                    errors.append(None)
                except Exception as e:  # the row's own record
                    wavs.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(**{out: wavs, "isolate_error": errors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, {extra}")


def retry_mismatched(df: DataFrame, factory: Callable[[], Recognizer], wav: str, mix: str, seconds: str, domain: str) -> DataFrame:
    """`df` (with asr_text, language, context) with asr_pass: texts that don't fit their duration are decoded anew.

    First as Chinese in the domain's context, unless that was how; then, still unfit, from the mix. An empty
    answer changes nothing. Only unfit rows reach a model.
    """
    plain = df.withColumn("asr_pass", F.lit("primary"))
    unfit = lambda: X.duration_mismatch(F.col("asr_text"), F.col(seconds))
    columns = plain.columns

    def again(rows: DataFrame, source: str, lang, context, name: str) -> DataFrame:
        asked = rows.withColumns({"__gl_old": F.col("asr_text"), "__gl_lang": lang, "__gl_ctx": context, "__gl_wav": F.col(source)}).drop("asr_text")
        said = recognize(asked, factory, "__gl_lang", "__gl_ctx", "__gl_wav")
        better = F.trim(F.coalesce("asr_text", F.lit(""))) != ""
        return said.withColumns({"asr_pass": F.when(better, name).otherwise(F.col("asr_pass")), "asr_text": F.when(better, F.col("asr_text")).otherwise(F.col("__gl_old"))}).select(*columns)

    def step(rows: DataFrame, which: Column, *args) -> DataFrame:
        which = F.coalesce(which, F.lit(False))
        return rows.where(~which).select(*columns).unionByName(again(rows.where(which), *args))

    asked = F.coalesce((F.col("language") == "Chinese") & (F.col("context") == domain), F.lit(False))
    once = step(plain, unfit() & ~asked, wav, F.lit("Chinese"), F.lit(domain), "retry_decode")
    return step(once, unfit() & F.col(mix).isNotNull(), mix, F.col("language"), F.col("context"), "retry_mix")
