"""Operator 9: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. It is called with one turn more each time; if
the new output begins with the old one, the rest is the span of the new turn, and the turn's text is looked up in that
span. A template whose new output does not begin with the old one rewrites history; that is reported, and its
conversations have no spans. Since it is only called and never looked into, the located spans hold for any template, and
every prefix of every conversation is rendered: the time grows with the square of a conversation's turns.

The built-in template marks turns and escapes the control strings of common chat formats in texts: a backslash goes
behind the first character of each, one more if there are some already, so the escape can be undone exactly and no
control string is left inside a text. Role names are percent-escaped, so they stay on their line.

Defined results: a null text or role is empty; turns are put in order of turn (null first), then role, then text;
repeated rows are turns of their own; a null conversation id is a conversation; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of public chat formats.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_RESTS = "|".join(sorted((re.escape(c[1:]) for c in CONTROLS), key=len, reverse=True))
_PLAIN = re.compile(rf"([<\[])(\\*)(?=(?:{_RESTS}))")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?=(?:{_RESTS}))")


@functools.lru_cache(1 << 12)
def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str) -> str:
    return "".join(f"%{ord(c):02x};" if c in "%<[\n" else c for c in role)


def _unrole(role: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), role)


def template(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{_role(r)}\n{escape(t)}{CLOSE}" for r, t in turns)


def locate(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, span of each turn, whether the template rewrote history), by rendering successive prefixes."""
    before = render([])
    spans: list[tuple[int, int]] = []
    for n in range(1, len(turns) + 1):
        now = render(turns[:n])
        if not now.startswith(before):
            return render(turns), [], True
        spans.append((len(before), len(now)))
        before = now
    return before, spans, False


def text_span(output: str, span: tuple[int, int], shown: str) -> tuple[int, int]:
    """Where a turn's text stands in its span: the last place where it is found, as headers come first."""
    at = output.rfind(shown, *span)
    return (at, at + len(shown)) if at >= 0 else (span[0], span[0])


def conversation(render: Callable[[list[Turn]], str], turns: list[Turn], learn: str = "assistant") -> tuple[str, list[tuple[int, int]], bool]:
    """(output, loss spans, rewrote history)."""
    output, spans, rewrites = locate(render, turns)
    if rewrites:
        return output, [], True
    loss = [text_span(output, s, escape(t)) for (r, t), s in zip(turns, spans, strict=True) if r == learn]
    return output, loss, False


def parse(output: str) -> list[Turn]:
    """The turns of the built-in template's output."""
    out = []
    for part in output.split(OPEN)[1:]:
        role, _, text = part.partition("\n")
        out.append((_unrole(role), unescape(text[: -len(CLOSE)])))
    return out


def formatted(conversations: DataFrame, render: Callable[[list[Turn]], str] = template) -> DataFrame:
    """conv_id, formatted, loss (array of [start, end) in code points), rewrites for each conversation."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, turns, ready = None, [], []

        def flush() -> None:
            out, loss, rewrites = conversation(render, turns)
            ready.append((key, out, [list(x) for x in loss], rewrites))

        for frame in frames:  # sorted by conversation: one is held at a time
            for conv, role, text in zip(frame["conv_id"], frame["role"], frame["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if turns and conv != key:
                    flush()
                    turns = []
                key = conv
                turns.append((role, text))
            if len(ready) > 500:
                yield pd.DataFrame(ready, columns=["conv_id", "formatted", "loss", "rewrites"]).astype({"conv_id": "Int64"})
                ready.clear()
        if turns:
            flush()
        yield pd.DataFrame(ready, columns=["conv_id", "formatted", "loss", "rewrites"]).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, formatted string, loss array<array<long>>, rewrites boolean")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, read back from the formatted
    texts and their loss masks alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, text, loss, rewrites in zip(frame["conv_id"], frame["formatted"], frame["loss"], frame["rewrites"], strict=True):
                turns, sha = parse(text), hashlib.sha256()
                for role, said in turns:
                    sha.update(f"{role}\n{said}\n".encode())
                learnt = "".join(unescape(text[a:b]) for a, b in loss)
                out.append((conv, len(turns), sha.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text), rewrites))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]).astype({"conv_id": "Int64"})

    return rows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
