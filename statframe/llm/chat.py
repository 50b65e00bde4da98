r"""Chat formatting: conversations become budgeted training windows with a loss mask.

The template writes a turn as ``### role: text</turn>\n``. Inside roles and texts a backslash is put before every backslash and every
control string (``###``, ``</turn>``, in roles also ``:``), so that a window can be read back exactly.

Windows hold whole turns. Prefix sums of the turns' tokens choose the spans: a window takes as many new turns as its budget allows, after
the conversation's system turn (a system turn at its begin) and up to ``history`` turns that precede the new ones. Only the texts of
assistant turns that are new in a window are under the loss mask, so each is a target once.

Token counts are made in the tasks that read the turns; what a conversation's spans are chosen from is one light row per turn, so the
texts of a very long conversation are spread by window, not by conversation.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statframe.llm.common import keep, per_batch

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUDGET = 1024
HISTORY = 2
#: Turns of one conversation held while its windows are chosen.
HELD = 1 << 16
SPANS = "array<struct<start:int,end:int>>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_PAIR = re.compile(r"\\(.)", re.S)
_HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_END = re.compile(r"(?:[^\\<]|\\.|<(?!/turn>))*", re.S)


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _PAIR.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text lies."""
    head = f"### {escape(role, True)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse(window: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    out, at = [], 0
    while at < len(window):
        head = _HEADER.match(window, at)
        body = _END.match(window, head.end())
        out.append((unescape(head[1]), unescape(body[0])))
        at = body.end() + len("</turn>\n")
    return out


def spans(tokens: np.ndarray, system: int, budget: int, history: int, seen: int = 0) -> list[tuple[int, int, int]]:
    """(first turn shown, first new turn, turn after the last) of each window; ``system`` leading turns are in every window, and the
    ``seen`` turns after them were in earlier windows.

    A turn that exceeds the budget alone has a window of its own; history gives way before new turns do.
    """
    total = np.concatenate([[0], np.cumsum(tokens)])
    fixed, out, new = int(total[system]), [], system + seen
    while new < len(tokens) or not out:
        room = total[new] + max(budget - fixed, 0)
        shown = new
        for back in range(min(history, new - system), 0, -1):
            # history may take at most half of the room, and the next new turn must still fit
            used = total[new] - total[new - back]
            if 2 * used <= budget - fixed and (new >= len(tokens) or total[new + 1] <= room - used):
                shown, room = new - back, room - used
                break
        after = min(len(tokens), max(new + 1, int(np.searchsorted(total, room, "right")) - 1))
        out.append((shown, new, after))
        new = after
    return out


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = BUDGET, history: int = HISTORY, ranks: str = RANKS) -> DataFrame:
    """``conv_id, window, text, n_tokens, repeated, loss``: the windows of every conversation.

    ``repeated`` counts the leading turns that an earlier window had, ``loss`` has the character spans under the mask. Turns are ordered by
    ``turn``, ties by role and a hash of the text; repeated rows are further turns. Null roles and texts are empty, rows with a null
    ``conv`` form one conversation with a null id, null turns come first. ``n_tokens`` sums the tokens of the turns, encoded one by one.
    """
    import tiktoken

    spark = turns.sparkSession
    with open(ranks, "rb") as f:
        table = spark.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    made: dict = {}

    def count(batch: pa.RecordBatch) -> dict:
        if "encoder" not in made:
            made["encoder"] = tiktoken.Encoding("turns", pat_str=PATTERN, mergeable_ranks=table.value, special_tokens={})
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        return {"n": [len(made["encoder"].encode_ordinary(render(r, t)[0])) for r, t in zip(get("role"), get("text"))]}

    slim = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = keep(per_batch(slim, count, n="int").withColumn("row", F.monotonically_increasing_id()))
    light = (counted.select("conv", "row", "n", (F.col("role") == "system").alias("system"), F.col("conv").isNull().alias("none"),
                            "turn", "role", F.xxhash64("text").alias("h"))
             .repartition("conv").sortWithinPartitions("none", "conv", "turn", "role", "h", "row").select("conv", "row", "n", "system"))

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of every turn: (row, window, place, repeated). Of a long conversation only what open windows need is held."""
        key, started = None, False
        rows, tokens, places, system, seen, window = [], [], [], 0, 0, 0

        def placed(end: bool):
            nonlocal rows, tokens, places, seen, window
            out, got = [], spans(np.array(tokens, np.int64), system, budget, history, seen)
            for shown, new, after in got if end else got[:-1]:
                out += [(rows[i], window, places[i], i < new and (window > 0 or i >= system)) for i in [*range(system), *range(shown, after)]]
                window += 1
            if not end:
                first = max(system, got[-1][1] - history)
                seen = got[-1][1] - first
                rows, tokens, places = (x[:system] + x[first:] for x in (rows, tokens, places))
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_()))],
                                              ["row", "window", "place", "old"])

        count_ = 0
        for batch in batches:
            for c, row, n, is_system in zip(*(x.to_pylist() for x in batch.columns)):
                if started and c != key:
                    yield placed(True)
                    rows, tokens, places, system, seen, window, count_ = [], [], [], 0, 0, 0, 0
                system += bool(is_system) and not rows
                key, started = c, True
                rows.append(row), tokens.append(n), places.append(count_)
                count_ += 1
                if len(rows) >= HELD:
                    yield placed(False)
        if rows:
            yield placed(True)

    places = light.mapInArrow(choose, "row long, window int, place long, old boolean")
    # a window holds at most its budget of tokens (or one turn): the lists below are bounded
    windows = (places.join(counted.select("row", "conv", "role", "text", "n"), "row")
               .groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text", "old", "n"))).alias("turns")))

    def write(batch: pa.RecordBatch) -> dict:
        texts, loss, repeated, n = [], [], [], []
        for own in batch.column(batch.schema.get_field_index("turns")).to_pylist():
            parts, masks, at = [], [], 0
            for t in own:
                s, a, b = render(t["role"], t["text"])
                if t["role"] == "assistant" and not t["old"]:
                    masks.append({"start": at + a, "end": at + b})
                parts.append(s)
                at += len(s)
            texts.append("".join(parts)), loss.append(masks)
            repeated.append(sum(t["old"] for t in own)), n.append(sum(t["n"] for t in own))
        return {"text": texts, "n_tokens": n, "repeated": repeated, "loss": loss}

    return (per_batch(windows, write, text="string", n_tokens="long", repeated="int", loss=SPANS)
            .select(F.col("conv").alias("conv_id"), "window", "text", "n_tokens", "repeated", "loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Digest of each conversation, read from its windows in order: turns that are new in a window, and the text under the mask."""
    import hashlib

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, names = None, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row():
            conv, n, all_, chars, loss, total = state
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([n]), pa.array([all_.hexdigest()]), pa.array([chars]),
                                               pa.array([loss.hexdigest()]), pa.array([total])], names)

        for batch in batches:
            for conv, text, repeated, masks in zip(*(x.to_pylist() for x in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        yield row()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for m in masks:
                    said = unescape(text[m["start"]:m["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
        if state is not None:
            yield row()

    return (windows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").isNull(), "conv_id", "window").select("conv_id", "text", "repeated", "loss")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
