"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template names what stands before and after a turn's text, the roles whose text bears loss, the control strings that
may not occur inside texts, and the machine: (state, role) -> state, with the states that may end a conversation.
Escaping doubles backslashes and puts `\\-` behind the first letter of every control string, so it can be undone.

Conversations are dealt by conv_id, sorted by turn (ties by role, then text) and streamed: a task holds one batch of
rows and one conversation's digests, however long the conversation is. Null texts and roles count as empty; rows without conv_id
are left out. Repeated rows are turns each. The empty table gives the empty table. Extra columns are ignored.
A conversation that the machine refuses is formatted all the same; `valid` is false and `bad_turn` is the first turn, in
order from 0, that it refuses (the number of turns, where only the end is wrong).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """{role} in `before` is the turn's role; everything else is literal."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    start: str = "start"
    moves: dict = field(default_factory=lambda: {("start", "system"): "opened", ("start", "user"): "asked", ("opened", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    ends: tuple[str, ...] = ("answered",)

    def pattern(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(re.escape(c) for c in self.controls) + ")(.)", re.DOTALL)


CHAT = Template()
_UNDO = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(r"\1\\-", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text)


def segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, turn_no, segment, text, loss, valid, bad_turn: three segments a turn, sorted within the partitions.

    valid and bad_turn tell the machine's verdict up to and including this turn; a conversation's last row, whose
    segment is 3 and whose text is empty, tells it of the whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, now, state, n, bad = template.pattern(), None, "", 0, -1
        rows: list[tuple] = []

        def ended() -> None:
            if now is not None:
                wrong = n if bad < 0 and state not in template.ends else bad
                rows.append((now, n, 3, "", False, wrong < 0, wrong))

        for frame in frames:
            for conv, role, text in zip(frame["conv_id"].tolist(), frame["role"].tolist(), frame["text"].tolist(), strict=True):
                if conv != now:
                    ended()
                    now, state, n, bad = conv, template.start, 0, -1
                role, text = role or "", text or ""
                state = template.moves.get((state, role), "") if bad < 0 else ""
                if bad < 0 and not state:
                    bad = n
                shown = escape(role, pattern).replace("\n", "\\n")
                verdict = (bad < 0, bad)
                rows.append((conv, n, 0, template.before.replace("{role}", shown), False, *verdict))
                rows.append((conv, n, 1, escape(text, pattern), role in template.loss_roles, *verdict))
                rows.append((conv, n, 2, template.after, False, *verdict))
                n += 1
            yield pd.DataFrame(rows, columns=["conv_id", "turn_no", "segment", "text", "loss", "valid", "bad_turn"])
            rows = []
        ended()
        yield pd.DataFrame(rows, columns=["conv_id", "turn_no", "segment", "text", "loss", "valid", "bad_turn"])

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").where("conv_id is not null")
    dealt = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInPandas(run, "conv_id long, turn_no long, segment int, text string, loss boolean, valid boolean, bad_turn long")


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """What the formatted segments say, one row a conversation; the segments must be as segments() leaves them.

    Turns and texts are parsed from the segments' text by the template, and unescaped.
    """
    head, tail = (re.escape(x) for x in template.before.split("{role}"))
    opening = re.compile(f"{head}(.*){tail}", re.DOTALL)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "bad_turn"]
        now, turns, loss, n, lost, chars = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for frame in frames:
            rows = []
            for conv, kind, text, bears, valid, bad in zip(*(frame[c].tolist() for c in ("conv_id", "segment", "text", "loss", "valid", "bad_turn")), strict=True):
                if conv != now:
                    now, turns, loss, n, lost, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(text)
                if m := opening.fullmatch(text) if kind == 0 else None:
                    turns.update(f"{unescape(m[1])}\n".encode())
                    n += 1
                elif kind == 1:
                    said = unescape(text)
                    turns.update(f"{said}\n".encode())
                    if bears:
                        loss.update(said.encode())
                        lost += len(said)
                elif kind == 3:
                    rows.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, valid, bad))
            yield pd.DataFrame(rows, columns=columns)

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, bad_turn long")
