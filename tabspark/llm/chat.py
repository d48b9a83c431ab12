"""Conversations rendered by a template, with the spans that a model is trained on."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import compile_template

Batches = Iterator[pa.RecordBatch]

# Strings that steer a model; none of them stands in an escaped text.
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TEMPLATE = (
    "{% for m in messages %}{{ '<|turn|>' + (m.role | escape) + '<|text|>' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|end|>' + '\\n' }}{% endfor %}"
)
_OPEN = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))


def escape(text: str) -> str:
    """Double each backslash, and put one after the first character of every control string."""
    return _OPEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``: two backslashes are one, a single one is none."""
    return re.sub(r"\\(\\?)", r"\1", text)


def _messages(batches: Batches) -> Iterator[tuple[int | None, str, str]]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())


def _format(template: str, chunk_chars: int) -> Callable[[Batches], Batches]:
    """Sorted turns to chunks (conv_id, chunk, text, spans); spans are places in the whole output."""

    def run(batches: Batches) -> Batches:
        render = compile_template(template, {"escape": escape})
        rows = _messages(batches)
        ahead = next(rows, None)
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            ids, numbers, texts, spans = (list(c) for c in zip(*out))
            out, held = [], 0
            spans = [[{"start": a, "end": z} for a, z in s] for s in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, kind)],
                names=["conv_id", "chunk", "formatted", "loss_spans"],
            )

        while ahead is not None:
            conv = ahead[0]

            def turns() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    now = {"role": ahead[1], "text": ahead[2]}
                    ahead = next(rows, None)
                    yield now

            number, parts, size, place = 0, [], 0, 0
            spans: list[tuple[int, int]] = []
            for text, generated in render({"messages": turns()}):
                if generated:
                    spans.append((place, place + len(text)))
                place += len(text)
                parts.append(text)
                size += len(text)
                if size >= chunk_chars:
                    out.append((conv, number, "".join(parts), spans))
                    number, parts, size, spans, held = number + 1, [], 0, [], held + size
                    if held >= 4 * chunk_chars:
                        yield flush()
            out.append((conv, number, "".join(parts), spans))
            held += size + 100
            if held >= 4 * chunk_chars:
                yield flush()
        if out:
            yield flush()

    return run


def format_conversations(
    conversations: DataFrame,
    template: str = TEMPLATE,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_chars: int = 1 << 20,
) -> DataFrame:
    """(conv_id, chunk, formatted, loss_spans): every conversation rendered by the template.

    Turns are sorted by turn number, NULL last, then by role and text; NULL roles and texts are empty;
    rows without a conversation id are one conversation of id NULL. Turns stream through the compiled
    template, so a conversation of any length takes bounded memory; its output comes in numbered chunks
    of about a million characters, nearly always one. Spans are in characters of the whole output
    of a conversation. An empty table gives no row; other columns are ignored.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("c"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.col(turn).alias("t"),
    )
    ordered = rows.repartition("c").sortWithinPartitions("c", F.col("t").asc_nulls_last(), "r", "x").select("c", "r", "x")
    return ordered.mapInArrow(
        _format(template, chunk_chars),
        "conv_id long, chunk int, formatted string, loss_spans array<struct<start: long, end: long>>",
    )


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def _digest(batches: Batches) -> Batches:
    """Chunks in order to one row a conversation, read back from the output alone."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(i).to_pylist() for i in range(4)))

    now, state = None, None
    out: list[tuple] = []

    def close() -> None:
        if state["rest"]:
            raise ValueError(f"Conversation {now} does not end with a whole turn")
        out.append((now, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]))

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return made

    for conv, _, text, spans in rows():
        if state is None or conv != now:
            if state is not None:
                close()
            now = conv
            state = {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "rest": ""}
        start = state["chars"] - len(state["rest"])
        for s in spans:
            said = unescape((state["rest"] + text)[s["start"] - start : s["end"] - start])
            state["loss"].update(said.encode())
            state["loss_chars"] += len(said)
        state["chars"] += len(text)
        whole, at = state["rest"] + text, 0
        for m in _TURN.finditer(whole):
            state["turns"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            state["n"] += 1
            at = m.end()
        state["rest"] = whole[at:]
        if len(out) >= 5000:
            yield batch()
    if state is not None:
        close()
    if out:
        yield batch()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from its formatted chunks of the default template: turns and
    their digest, characters and digest of the text under the loss spans, and length."""
    ordered = formatted.select("conv_id", "chunk", "formatted", "loss_spans")
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
