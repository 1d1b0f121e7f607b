"""Chat formatting by event sourcing: a conversation's log is folded into its final messages, then rendered.

Events, in the order of seq within a conversation:

* message     a whole message: message_id, role, text
* start       an empty message that deltas fill
* delta       text appended to a message (one that is unknown starts with the event's role)
* edit        the message's text is replaced and all later messages go, as in a chat window
* regenerate  the message is emptied for new deltas and all later messages go
* delete      the message goes
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

EVENTS = "conv_id bigint, seq bigint, kind string, message_id bigint, role string, text string"
FIELDS = ("conv_id", "seq", "kind", "message_id", "role", "text")
SCHEMA = "conv_id bigint, n_messages int, n_user int, n_assistant int, rendered string"


class Fold:
    """State of one conversation: messages in the order they were opened."""

    def __init__(self) -> None:
        self.messages: dict[object, list] = {}

    def _cut_after(self, key: object) -> None:
        keys = list(self.messages)
        for k in keys[keys.index(key) + 1 :]:
            del self.messages[k]

    def apply(self, kind: str | None, key: object, role: str | None, text: str | None) -> None:
        m = self.messages.get(key)
        if kind in ("message", "start"):
            body = [text or ""] if kind == "message" else []
            if m is None:
                self.messages[key] = [role or "user", body]
            else:
                m[:] = [role or m[0], body]
        elif kind == "delta":
            if m is None:
                m = self.messages[key] = [role or "assistant", []]
            m[1].append(text or "")
        elif m is not None and kind in ("edit", "regenerate"):
            m[1] = [text or ""] if kind == "edit" else []
            self._cut_after(key)
        elif m is not None and kind == "delete":
            del self.messages[key]

    def final(self) -> list[tuple[str, str]]:
        return [(r, "".join(b)) for r, b in self.messages.values()]


def render(messages: list[tuple[str, str]]) -> str:
    """ChatML-like turns. Markers inside a text are broken up so that they can't end a turn."""
    safe = [(r, t.replace("<|im_", "<| im_")) for r, t in messages]
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in safe)


def fold_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_messages, n_user, n_assistant, rendered.

    Events are partitioned by conv_id and sorted by seq; of equal seq by message_id, kind and text, so ties
    have one order. A repeated event is applied again, save exact duplicates of a (conv_id, seq, message_id,
    kind, role, text), which at-least-once delivery produces: they count once. Null seq comes first; events
    with a null conv_id or message_id, or of an unknown kind, are left out, and edits of unknown messages do
    nothing. A null text is empty, a null role "user" ("assistant" for a delta). A conversation whose messages
    are all deleted has a row with an empty rendering; an empty log gives no rows. Other columns are ignored.
    Only the conversation at hand is held in memory.
    """
    src = events.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in EVENTS.split(", "))]).where("conv_id IS NOT NULL AND message_id IS NOT NULL")
    order = ["conv_id", "seq", "message_id", "kind", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, fold, last, rows = None, None, None, []

        def done() -> None:
            msgs = fold.final()
            rows.append((conv, len(msgs), sum(r == "user" for r, _ in msgs), sum(r == "assistant" for r, _ in msgs), render(msgs)))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], ["conv_id", "n_messages", "n_user", "n_assistant", "rendered"])

        for batch in batches:
            for event in zip(*[c.to_pylist() for c in batch.columns]):
                if event == last:
                    continue
                if event[0] != conv:
                    if fold is not None:
                        done()
                    conv, fold = event[0], Fold()
                last = event
                fold.apply(event[2], event[3], event[4], event[5])
            if len(rows) >= 256:
                yield batch_of()
        if fold is not None:
            done()
        if rows:
            yield batch_of()

    return src.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, SCHEMA)


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, m, n, role, text): the rows of each conversation in the order of (turn, role, text), nulls first, numbered from 1; n is their number. Rows without conv_id or turn go; a row that is repeated is two messages."""
    src = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = Window.partitionBy("conv_id")
    return src.select(F.col("conv_id").cast("long").alias("conv_id"), F.row_number().over(own.orderBy("turn", "role", "text")).cast("long").alias("m"), F.count("*").over(own).alias("n"), "role", F.coalesce("text", F.lit("")).alias("text"))


def _event(kind: str, message: Column, role: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), message.cast("long").alias("message_id"), role.alias("role"), text.alias("text"))


def _streamed(message: Column, text: Column) -> Column:
    """One delta for each line."""
    lines = F.split(text, "\n")
    return F.transform(lines, lambda x, i: _event("delta", message, F.lit("assistant"), F.when(i == 0, x).otherwise(F.concat(F.lit("\n"), x))))


def _logged(rows: DataFrame, place: Column, events: Column) -> DataFrame:
    """Events of each row in their order, after those of rows with a smaller place (below 2^31)."""
    flat = rows.select("conv_id", place.cast("long").alias("place"), F.posexplode(events).alias("k", "e"))
    return flat.select("conv_id", (F.shiftleft("place", 32) + F.col("k")).alias("seq"), "e.kind", "e.message_id", "e.role", "e.text")


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """A log from finished turns: users and systems send whole messages, assistants stream one delta a line.

    A conversation's rows are numbered in the order of (turn, role, text), nulls first; the number is the message's
    id, so rows that share a turn, or are equal, stay messages of their own. Rows without conv_id or turn are left
    out, a null text is empty, a null role "user"; other columns are ignored; an empty table gives no events. The fold gives
    the turns back as they were.
    """
    m, role, text = F.col("m"), F.col("role"), F.col("text")
    return _logged(_numbered(conversations), m, F.when(role == "assistant", _streamed(m, text)).otherwise(F.array(_event("message", m, role, text))))


#: Messages of a log that never stay have ids from here on.
PASSING = 1 << 40


def revised_events(conversations: DataFrame) -> DataFrame:
    """A log as a chat service would have kept it, made from finished turns: with drafts, edits, regenerations and deletions.

    Passing ones, which leave no trace: every third message of a user is a draft first and then edited; every
    fourth of an assistant is streamed in another wording, answered and then regenerated; before every fifth message
    stands one that is deleted. Lasting ones, at the end of the log, by conv_id modulo 7:

    * 1: every message whose number is 4 modulo 6 is deleted;
    * 3: the second message is edited to end in " (edited)", so later ones go;
    * 5: the last message of an assistant is regenerated to begin with "Again: ", so later ones go.

    Rows are numbered and nulls treated as in turns_as_events().
    """
    rows = _numbered(conversations)
    m, n, role, text, kind = F.col("m"), F.col("n"), F.col("role"), F.col("text"), F.col("conv_id") % 7
    none = F.array().cast("array<struct<kind:string,message_id:bigint,role:string,text:string>>")
    user, bot = F.lit("user"), F.lit("assistant")
    stray = F.when(m % 5 == 0, F.array(_event("message", m + PASSING, user, F.lit("wrong window")), _event("delete", m + PASSING, user, F.lit(None).cast("string")))).otherwise(none)
    whole = F.when(m % 3 == 0, F.array(_event("message", m, role, F.concat(F.lit("draft of "), text)), _event("edit", m, role, text))).otherwise(F.array(_event("message", m, role, text)))
    again = F.concat(_streamed(m, F.concat(F.lit("no: "), text)), F.array(_event("message", m + 2 * PASSING, user, F.lit("once more, please")), _event("regenerate", m, bot, F.lit(None).cast("string"))), _streamed(m, text))
    first = _logged(rows, m, F.concat(stray, F.when(role == "assistant", F.when(m % 4 == 0, again).otherwise(_streamed(m, text))).otherwise(whole)))
    mine = F.when((kind == 1) & (m % 6 == 4), F.array(_event("delete", m, role, F.lit(None).cast("string"))))
    mine = mine.when((kind == 3) & (m == 2), F.array(_event("edit", m, role, F.concat(text, F.lit(" (edited)")))))
    last = rows.withColumn("_top", F.max(F.when(role == "assistant", m)).over(Window.partitionBy("conv_id")))
    mine = mine.when((kind == 5) & (m == F.col("_top")), F.concat(F.array(_event("regenerate", m, bot, F.lit(None).cast("string"))), _streamed(m, F.concat(F.lit("Again: "), text))))
    return first.union(_logged(last, n + m, mine.otherwise(none)))
