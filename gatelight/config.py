"""One object for the settings of a run, from keywords or from the environment (GATELIGHT_<NAME>)."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# Pipelines, norm modes and window modes that a run can name.
PIPELINES = ("ps4", "wesep", "sep_route", "mix", "cond_tasnet")
NORMS = ("raw", "enroll_znorm", "test_znorm", "asnorm")
WINDOWS = ("off", "slide", "energy")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; impossible ones raise, and settings that exclude each other are resolved by `resolved`."""

    data_dir: str = ""
    out_dir: str = ""
    pipeline: str = "ps4"
    limit: int = 0
    presence_backend: str = "eres2netv2"
    use_sep: bool = True
    lang_split: bool = True
    enroll_vad: bool = True
    locked_thr: bool = True
    force_calib: bool = False
    skip_asr: bool = False
    extra_reject: bool = True
    target_frr: float = 0.02
    holdout_frac: float = 0.0
    holdout_seed: int = 0
    cmd_windows: str = "off"
    veto_encoder: bool = False
    veto_windows: bool = False
    asr_language: str = ""
    asr_context: str = ""
    asr_hotwords: bool = False
    asr_domain_context: bool = False
    asr_wake_context: bool = False
    asr_guess_language: bool = False
    asr_retry_mismatch: bool = False
    wav_source: str = "extracted"
    chunks: int = 0
    asnorm: bool = False
    enroll_znorm: bool = False
    test_znorm: bool = False
    cohort_dir: str = ""
    test_cohort_dir: str = ""

    def __post_init__(self):
        for name, known in (("pipeline", PIPELINES), ("cmd_windows", WINDOWS)):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} is {getattr(self, name)!r}, not one of {', '.join(known)}")
        if not 0 <= self.holdout_frac < 1:
            raise ValueError("holdout_frac is a share under 1")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **over) -> RunConfig:
        """Settings that the environment names, empty ones as their defaults; 0, false, no and off are false."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(f"GATELIGHT_{f.name.upper()}", "").strip()
            if text:
                kind = type(f.default)
                found[f.name] = text.lower() not in ("0", "false", "no", "off") if kind is bool else kind(text)
        return cls(**{**found, **over})

    def resolved(self) -> RunConfig:
        """Routes need a separation; a forced calibration or command windows undo the locked threshold, which needs no enrolment VAD."""
        locked = self.locked_thr and not self.force_calib and self.cmd_windows == "off"
        return replace(self, use_sep=self.use_sep or self.pipeline == "sep_route", locked_thr=locked, enroll_vad=self.enroll_vad and not locked)

    @property
    def norm(self) -> str:
        """Cohort norm of calibration: both sides asked for, by flag or by cohort, is asnorm."""
        sides = (self.enroll_znorm or bool(self.cohort_dir), self.test_znorm or bool(self.test_cohort_dir))
        return "asnorm" if self.asnorm or all(sides) else {(True, False): "enroll_znorm", (False, True): "test_znorm", (False, False): "raw"}[sides]

    def run_norm(self, calibrated: str | None) -> str:
        """Cohort norm of a run whose threshold was calibrated under a norm (raw if unknown); a test cohort adds the test side."""
        calibrated = calibrated or "raw"
        flags = (("asnorm", self.asnorm), ("test_znorm", self.test_znorm), ("enroll_znorm", self.enroll_znorm or bool(self.cohort_dir)))
        if calibrated == "raw" and not any(on for _, on in flags):
            return "raw"
        mode = next((n for n, on in flags if on or calibrated == n), "raw")
        return {"enroll_znorm": "asnorm", "raw": "test_znorm"}.get(mode, mode) if self.test_cohort_dir else mode

    def tags(self) -> list[str]:
        return [self.presence_backend, "sep1" if self.use_sep else "nosep", "ls" if self.lang_split else "gthr", "vad" if self.enroll_vad else "novad", self.norm]

    def calibration_dir(self) -> str:
        return "_".join(["presence_calib", *self.tags()])

    def decode_tag(self) -> str:
        """Provenance of a transcript: a record with another tag is made anew."""
        lang = self.asr_language or ("guess" if self.asr_guess_language else "auto")
        asked = (("custom", self.asr_context.strip()), ("hotwords", self.asr_hotwords), ("domain", self.asr_domain_context), ("wake", self.asr_wake_context))
        context = next((n for n, on in asked if on), "none")
        wav = "mix" if self.wav_source == "mix" else "extracted"
        return f"vm-cer-v2|lang={lang}|ctx={context}|retry={int(self.asr_retry_mismatch)}|wav={wav}"
