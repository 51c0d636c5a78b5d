"""Chat formatting with a template as a black box: successive prefixes of turns are rendered and compared."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text

PIECES = "turn long, role string, piece string, start long, stop long, loss_start long, loss_stop long, rewrites boolean, exact boolean"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


@dataclass(frozen=True)
class Template:
    """render: any function of a list of turns; nothing is known of it but what reach says. read gives the turns of a rendered
    piece, unescape the text that a rendered text stands for; only what reads a rendering back needs them.

    reach: a template that names it promises that what a turn adds depends on the first turn and the `reach` turns before it
    only, and that no turn changes what is rendered. Of any other all turns are rendered, however many there are.
    """

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str]
    read: Callable[[str], list[Turn]]
    reach: int | None = None


# Fixed values of the ChatML format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _escape(text: str) -> str:
    """Text in which no control string can stand: each backslash is doubled and `<|` is parted by one."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def _chatml(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{_escape(role).replace('\n', '\\n')}\n{_escape(text)}{CLOSE}\n" for role, text in turns)


def _read_chatml(piece: str) -> list[Turn]:
    found = []
    for part in piece.split(OPEN)[1:]:
        role, _, rest = part.partition("\n")
        found.append((_unescape(role), _unescape(rest[: rest.rindex(CLOSE)])))
    return found


CHATML = Template(_chatml, _unescape, _read_chatml, reach=0)


def common_prefix(a: str, b: str) -> int:
    """How many code points two strings share from the first on."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Renderer:
    """The pieces that a conversation's turns add to its rendering, one after the other.

    The turns so far are rendered again with each turn, and what they have in common with the rendering before is kept. Of a template
    that names its reach, turns beyond it are let go when there are `window` turns or `chars` code points; by its promise, the
    pieces are the same for any window. All turns of any other template stay, whatever that costs.
    """

    def __init__(self, template: Template, loss_roles: frozenset[str], window: int = 512, chars: int = 4_000_000):
        self.template, self.loss_roles, self.window, self.chars = template, loss_roles, window, chars
        self.turns: list[Turn] = []
        self.before = ""  # the rendering of self.turns
        self.skipped = 0  # code points of the whole rendering less those of self.before

    def add(self, role: str, text: str) -> tuple:
        """piece, start, stop, loss_start, loss_stop, rewrites, exact."""
        render = self.template.render
        reach = self.template.reach
        if reach is not None and len(self.turns) > reach + 1 and (len(self.turns) >= self.window or len(self.before) > self.chars):
            self._let_go(reach)
        self.turns.append((role, text))
        out = render(self.turns)
        kept = common_prefix(self.before, out)
        rewrites = kept < len(self.before)
        piece, start = out[kept:], self.skipped + kept
        loss, exact = (None, None), True
        if role in self.loss_roles:
            # Two renderings that differ in a one-letter text only: what they share is before and behind it.
            a, b = (render([*self.turns[:-1], (role, probe)]) for probe in "AB")
            head = common_prefix(a, b)
            tail = len(a) - head - 1
            said = out[head : len(out) - tail]
            exact = len(a) == len(b) and head + tail <= len(out) and self.template.unescape(said) == text
            loss = (self.skipped + head, self.skipped + max(head, len(out) - tail))
        self.before = out
        return piece, start, self.skipped + len(out), *loss, rewrites, exact

    def _let_go(self, reach: int) -> None:
        self.turns = [self.turns[0], *self.turns[len(self.turns) - reach :]]
        out = self.template.render(self.turns)
        self.skipped += len(self.before) - len(out)
        self.before = out


def format_turns(conversations: DataFrame, template: Template = CHATML, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", window: int = 512, order: tuple[Column, ...] = ()) -> DataFrame:
    """One row per row of conversations: conv_id, turn, role, piece (what the turn adds to the rendering), start and stop (its
    code points in the conversation's whole rendering), loss_start and loss_stop (of the text, for roles under the loss mask),
    rewrites (the rendering of the turns before does not begin this one: start is where they part, and the pieces behind it
    are void), exact (the text under the mask decodes to the turn's text; templates may cut or change texts).

    Rows of a conversation go by turn (null last), then `order`, role and text. A null role or text is empty. Rows without a
    conv_id are one conversation. Repeated rows are turns of their own. An empty table gives no rows; other columns are not looked at.

    A conversation's rows come together and in order in one partition, and are rendered as they come: of a template that names
    its reach a task holds some `window` turns of one conversation, however long it is; of any other, all of them (see Renderer).
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[c.alias(f"order{i}") for i, c in enumerate(order)])
    keys = ["conv_id", F.col("turn").asc_nulls_last(), *[f"order{i}" for i in range(len(order))], "role", "text"]
    rows = rows.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")
    masked = frozenset(loss_roles)
    names = ["conv_id", *(part.split()[0] for part in PIECES.split(", "))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, kind = object(), None, None
        schema = None
        for batch in batches:
            kind = batch.schema.field(0).type
            schema = pa.schema([("conv_id", kind), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()), *[(c, pa.int64()) for c in names[4:8]], ("rewrites", pa.bool_()), ("exact", pa.bool_())])
            out, held = [], 0
            for own, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != conv:
                    conv, state = own, Renderer(template, masked, window)
                out.append((own, turn, role, *state.add(role, text)))
                held += len(text)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(each, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PIECES}")


def read_back(pieces: DataFrame, template: Template = CHATML, arranged: bool = False) -> DataFrame:
    """One row per conversation, from the pieces of format_turns alone: conv_id, n_turns, turns_sha256 (of role, line end, text,
    line end of each turn), loss_chars and loss_sha256 (of the texts under the mask), formatted_chars, rewrites.

    The digests are made as the pieces come, so no task holds a conversation. `arranged` says that they come as format_turns gives
    them; pieces that have been stored are dealt anew, by start. A conversation that its template has rewritten has null digests.
    """
    rows = pieces.select("conv_id", "piece", "start", "stop", "loss_start", "loss_stop", "rewrites")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "stop", "start")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, has, kind = None, False, pa.int64()
        turns = loss = None
        n = chars = stop = 0
        rewritten = False

        def told() -> pa.RecordBatch:
            row = (conv, None if rewritten else n, None if rewritten else turns.hexdigest(), None if rewritten else chars, None if rewritten else loss.hexdigest(), stop, rewritten)
            types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["conv_id", *(part.split()[0] for part in DIGESTS.split(", "))])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, piece, start, stop_, loss_start, loss_stop, rewrites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not has or own != conv:
                    if has:
                        yield told()
                    conv, has, turns, loss, n, chars, rewritten = own, True, hashlib.sha256(), hashlib.sha256(), 0, 0, False
                stop = stop_
                rewritten |= rewrites
                if rewritten:
                    continue
                for role, text in template.read(piece):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss_start is not None:
                    said = template.unescape(piece[loss_start - start : loss_stop - start])
                    chars += len(said)
                    loss.update(said.encode("utf-8", "surrogatepass"))
        if has:
            yield told()

    return rows.mapInArrow(each, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {DIGESTS}")
