"""Decision rules as boolean columns; only those named rescue turn a reject into an accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatelight.operators.cube import Axis, Box, flag, no, yes

# Frozen thresholds and overlay parameters.
ZH_THRESHOLD, EN_THRESHOLD = 0.29305, 0.357868
GRAY, MIN_LENGTH, MARGIN = 0.10, 15, 0.12


def frozen_threshold(lang: Column) -> Column:
    return F.when(F.coalesce(lang, F.lit("zh")) == "zh", ZH_THRESHOLD).otherwise(EN_THRESHOLD)


def threshold_from_map(by_lang: Column, lang: Column, overall: Column) -> Column:
    return F.coalesce(F.try_element_at(by_lang, lang), F.try_element_at(by_lang, F.lit("default")), overall)


def upper_gray(score: Column, thr: Column, width: float = GRAY) -> Column:
    return (score - thr).between(0.0, width)


def gray_band(score: Column, thr: Column, width: float) -> Column:
    return F.abs(score - thr) <= width


def text_reject(score: Column, thr: Column, text_len: Column, task: Column, width: float = GRAY, least: int = MIN_LENGTH) -> Column:
    return upper_gray(score, thr, width) & (text_len >= least) & ~task


def veto(score: Column, other: Column, thr: Column, width: float = GRAY, margin: float = MARGIN) -> Column:
    """A second encoder's or window's score is clearly lower; null never vetoes."""
    return F.coalesce(upper_gray(score, thr, width) & (other < score - margin), F.lit(False))


def overlay_reason(base: Column, text: Column, encoder: Column, window: Column) -> Column:
    return F.when(base, "score").when(text, "text").when(encoder, "encoder_veto").when(window, "window_veto")


def overlay_tag(*named: tuple[str, Column]) -> Column:
    """Names of the rules that hold, joined by +."""
    return F.concat_ws("+", *[F.when(cond, F.lit(name)) for name, cond in named])


def two_way(below: Column, gray: Column, task: Column, text_len: Column, rescue: bool, extra: bool, length: int = 16) -> Column:
    """Whether to reject after correcting the gray band by text in one or both directions."""
    out = below
    if rescue:
        out = F.when(below & gray & task & (text_len < length), False).otherwise(out)
    if extra:
        out = F.when(~below & gray & ((text_len >= length) | ~task), True).otherwise(out)
    return out


def text_rule(kind: str, margin: Column, primary: Column, text_len: Column, task: Column, delta: float, length: int) -> Column:
    """Extra reject of accepted rows by one of the named kinds."""
    gray, long = margin.between(0, delta), text_len >= length
    tts, chat = primary == "设备播报", primary.isin("闲聊/背景", "其他", "空转写")
    return {
        "tts_anywhere": tts, "tts_gray": gray & tts, "len_gray": gray & long, "nontask_gray": gray & ~task, "chat_gray": gray & chat,
        "len_or_nontask_gray": gray & (long | ~task), "len_and_nontask_gray": gray & long & ~task, "len_or_chat_gray": gray & (long | chat),
        "len_and_chat_gray": gray & long & chat, "len_anywhere": long, "len_gray_or_tts": tts | (gray & long), "len_or_chat_gray_or_tts": tts | (gray & (long | chat)),
    }[kind]


def text_axes(margin: Column, primary: Column, text_len: Column, task: Column, deltas: tuple, lengths: tuple) -> list[Axis]:
    """What the kinds of `text_rule` look at, for grids of them; `below` says that the row is rejected already."""
    chat = primary.isin("闲聊/背景", "其他", "空转写")
    return [
        flag("below", F.col("reject")), flag("up", margin >= 0), Axis("gray", tuple(deltas), lambda c: margin > c), Axis("length", tuple(lengths), lambda c: text_len >= c),
        flag("tts", primary == "设备播报"), flag("chat", chat), flag("task", task),
    ]


def text_boxes(kind: Column, delta: Column, length: Column) -> list[Box]:
    """The rejects of each kind of `text_rule`, and of the score, as boxes that don't meet."""
    gray, long, short = {**yes("up"), "gray": (None, delta)}, {"length": (length, None)}, {"length": (None, length)}
    kinds = {
        "tts_anywhere": [yes("tts")], "tts_gray": [{**gray, **yes("tts")}], "len_gray": [{**gray, **long}], "nontask_gray": [{**gray, **no("task")}],
        "chat_gray": [{**gray, **yes("chat")}], "len_or_nontask_gray": [{**gray, **long}, {**gray, **short, **no("task")}],
        "len_and_nontask_gray": [{**gray, **long, **no("task")}], "len_or_chat_gray": [{**gray, **long}, {**gray, **short, **yes("chat")}],
        "len_and_chat_gray": [{**gray, **long, **yes("chat")}], "len_anywhere": [long], "len_gray_or_tts": [yes("tts"), {**no("tts"), **gray, **long}],
        "len_or_chat_gray_or_tts": [yes("tts"), {**no("tts"), **gray, **long}, {**no("tts"), **gray, **short, **yes("chat")}],
    }
    return [Box(yes("below")), *[Box({**no("below"), **b}, kind == k) for k, boxes in kinds.items() for b in boxes]]


def band_mode(mode: str, below: Column, gray: Column, empty: Column, command: Column, wake_only: Column, wake_in: Column) -> Column:
    """Reject by score, corrected within the gray band by the recognised text."""
    no = {"score_only": F.lit(False), "gray_reject_empty": empty, "gray_reject_not_cmd": ~command, "gray_reject_wake_only": wake_only | empty, "gray_reject_empty_or_wake": empty | wake_only | wake_in, "gray_accept_cmd": F.lit(False)}[mode]
    yes = command & ~empty if mode == "gray_accept_cmd" else F.lit(False)
    return F.when(gray & yes, False).when(gray & no, True).otherwise(below)


def decision(score: Column, thr: Column, stream_status: Column) -> Column:
    """reject, accept, accept_no_tse, stream_error or pipeline_error."""
    done = F.when(stream_status == "ok", "accept").when(stream_status == "none", "accept_no_tse").otherwise("stream_error")
    return F.when(score.isNull(), "pipeline_error").when(score < thr, "reject").otherwise(done)


def worthwhile(gain: Column, extra_positives: Column) -> Column:
    return (gain >= 0.005) & (extra_positives <= 5)
