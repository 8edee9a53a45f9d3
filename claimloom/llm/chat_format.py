"""Chat formatting by a grammar that round-trips.

    chat := turn*            turn := "### " role ": " body "</turn>" newline

A backslash makes the next character literal. A turn is first rendered as it is; the
deterministic parser reads it back, and while role or text differ from the source the
next stricter escape is tried: backslashes doubled, then control strings broken too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm._common import require

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"


def _control(text: str, *strings: str) -> str:
    for s in strings:
        text = text.replace(s, "\\" + s)
    return text


#: Escapes for (role, text), from the lightest to one that always round-trips.
_ESCAPES = (
    lambda role, text: (role, text),
    lambda role, text: (role.replace("\\", "\\\\"), text.replace("\\", "\\\\")),
    lambda role, text: (_control(role.replace("\\", "\\\\"), MIDDLE, ":"), _control(text.replace("\\", "\\\\"), OPEN, CLOSE.strip())),
    lambda role, text: ("".join("\\" + c for c in role), "".join("\\" + c for c in text)),
)


class ParseError(ValueError):
    pass


def unescape(raw: str) -> str:
    if "\\" not in raw:
        return raw
    out, at = [], 0
    while (i := raw.find("\\", at)) >= 0:
        if i + 1 == len(raw):
            raise ParseError("nothing to escape")
        out.append(raw[at:i])
        out.append(raw[i + 1])
        at = i + 2
    out.append(raw[at:])
    return "".join(out)


def _find(text: str, what: str, at: int) -> int:
    """The first unescaped `what` from `at`; -1 if there is none."""
    slash = text.find("\\", at)
    hit = text.find(what, at)
    while hit >= 0 and 0 <= slash < hit:
        at = slash + 2
        slash = text.find("\\", at)
        if hit < at:
            hit = text.find(what, at)
    return hit


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that starts at `at`: role, text, start and end of its escaped body, and where the next turn starts."""
    if not text.startswith(OPEN, at):
        raise ParseError(f"no turn at {at}")
    role_at = at + len(OPEN)
    middle = _find(text, MIDDLE, role_at)
    if middle < 0:
        raise ParseError("a turn without a role")
    body = middle + len(MIDDLE)
    end = _find(text, CLOSE, body)
    if end < 0:
        raise ParseError("a turn that doesn't end")
    return unescape(text[role_at:middle]), unescape(text[body:end]), body, end, end + len(CLOSE)


def parse_chat(text: str) -> list[tuple[str, str, int, int]]:
    """All turns of a rendered chat: role, text, start and end of the escaped body."""
    at, turns = 0, []
    while at < len(text):
        role, body, start, end, at = parse_turn(text, at)
        turns.append((role, body, start, end))
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn with the lightest escape that reads back identically."""
    for escape in _ESCAPES:
        r, t = escape(role, text)
        out = f"{OPEN}{r}{MIDDLE}{t}{CLOSE}"
        try:
            if parse_turn(out)[:2] == (role, text) and len(parse_chat(out)) == 1:
                return out
        except ParseError:
            pass
    raise AssertionError("the last escape round-trips")


_TURNS = "conv_id long, turn long, role string, rendered string, start long, loss_start long, loss_end long"


def _place(loss_roles: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, at, begun = None, 0, False
        for pdf in batches:
            starts, begins, ends, roles = [], [], [], []
            for c, rendered in zip(pdf["conv_id"].astype("Int64"), pdf["rendered"], strict=True):
                c = None if pd.isna(c) else int(c)
                if not begun or c != conv:
                    conv, at, begun = c, 0, True
                role, _, body, end, _ = parse_turn(rendered)
                masked = role in loss_roles
                starts.append(at)
                begins.append(at + body if masked else None)
                ends.append(at + end if masked else None)
                roles.append(role)
                at += len(rendered)
            yield pd.DataFrame({"conv_id": pdf["conv_id"].astype("Int64"), "turn": pdf["turn"].astype("Int64"), "role": roles, "rendered": pdf["rendered"], "start": starts, "loss_start": pd.array(begins, dtype="Int64"), "loss_end": pd.array(ends, dtype="Int64")})

    return run


def format_turns(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: conv_id, turn, role, rendered text, its start in the chat, and the span under the loss mask.

    Concatenating `rendered` by `start` gives the formatted chat. Rows are ordered by
    turn, ties and repeated rows by role and text; null turns come first. Null texts
    and roles count as empty; rows with a null conv_id form one chat. Spans are code
    points in the formatted chat, null outside `loss_roles`. conv_id and turn must be
    whole numbers or text that reads as such. Other columns are ignored, whatever their
    names; an empty table gives an empty result. Turns of any length are rendered where
    they lie; a chat's turns then stream through one task in order, one turn in memory
    at a time, as the place of a turn and a chat's digest depend on all before.
    """
    require(rows, "conv_id", "turn", "role", "text")

    @F.pandas_udf("string")
    def render(roles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([render_turn(r, t) for r, t in zip(roles, texts, strict=True)], dtype=object)

    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    drawn = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    drawn = drawn.select("conv_id", "turn", "role", "text", render("role", "text").alias("rendered"))
    placed = drawn.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "rendered")
    return placed.mapInPandas(_place(frozenset(loss_roles)), _TURNS)


class Reader:
    """Reads a formatted chat that comes in pieces: turns by the parser, masked text by its spans. Holds one turn at a time."""

    def __init__(self) -> None:
        self.n, self.chars, self.loss_chars, self.buffer, self.at = 0, 0, 0, "", 0
        self.turns, self.loss, self.spans = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, piece: str, start: int, loss: tuple[int, int] | None) -> None:
        """The piece that stands at `start`, and the span of the whole chat that is under the loss mask there."""
        if start != self.chars:
            raise ParseError(f"a piece at {start} where the chat goes on at {self.chars}")
        self.chars += len(piece)
        self.buffer += piece
        if loss is not None:
            self.spans.append(loss)
        # a piece is one or more whole turns
        done = 0
        while done < len(self.buffer):
            role, text, _, _, done = parse_turn(self.buffer, done)
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        while self.spans and self.spans[0][1] <= self.at + done:
            begin, end = self.spans.pop(0)
            text = unescape(self.buffer[begin - self.at : end - self.at])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.buffer, self.at = self.buffer[done:], self.at + done

    def row(self, conv) -> tuple:
        if self.buffer or self.spans:
            raise ParseError("a chat that doesn't end")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, chat = None, None
    for pdf in batches:
        out = []
        spans = zip(pdf["loss_start"].astype("Int64"), pdf["loss_end"].astype("Int64"), strict=True)
        for c, rendered, start, (begin, end) in zip(pdf["conv_id"].astype("Int64"), pdf["rendered"], pdf["start"], spans, strict=True):
            c = None if pd.isna(c) else int(c)
            if chat is None or c != conv:
                if chat is not None:
                    out.append(chat.row(conv))
                conv, chat = c, Reader()
            chat.feed(rendered, int(start), None if pd.isna(begin) else (int(begin), int(end)))
        if out:
            yield _frame(out)
    if chat is not None:
        yield _frame([chat.row(conv)])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return frame.assign(conv_id=pd.array(frame["conv_id"], dtype="Int64"))


def chat_digests(turns: DataFrame, in_order: bool = False) -> DataFrame:
    """Per chat of format_turns(): counts and digests of what is read back from the formatted chat.

    A chat is assembled from its pieces by their start and read as a whole, in a stream:
    the parser gives the turns, loss_start and loss_end cut the masked text out of the
    chat. A piece that doesn't join the one before raises. `in_order` says that the rows
    come straight from format_turns(), where a chat's turns lie together and in order;
    else they are brought together first. An empty table gives an empty result.
    """
    require(turns, "conv_id", "rendered", "start", "loss_start", "loss_end")
    turns = turns.select("conv_id", "rendered", "start", "loss_start", "loss_end")
    if not in_order:
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return turns.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
