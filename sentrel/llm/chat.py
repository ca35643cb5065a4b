"""Chat formatting with loss masks that are aligned by offsets.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>`` for every turn. Control strings of this
and of other common templates inside roles and texts get a backslash after their first letter;
where backslashes stand there already, one more. Removing one backslash at every such place gives
the text back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import slices, tokenizer_path

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What follows the first letter of a control string: <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_TAIL = r"(?:(?<=<)\\*(?=\||/?s>|</?SYS>>)|(?<=\[)\\*(?=/?INST\]))"
_ESCAPE = re.compile(_TAIL)
_UNESCAPE = re.compile(r"(?:(?<=<)\\(?=\\*(?:\||/?s>|</?SYS>>))|(?<=\[)\\(?=\\*/?INST\]))")
_READ = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The whole conversation, and begin and end of each turn's text in it (code points)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at = spans[-1][1] + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _READ.findall(formatted)]


@cache
def _tokenizer(name: str):
    """The tokenizer with the template's marks as tokens of their own, so that none of its other
    tokens reaches over a border of a text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    model = Tokenizer.from_file(tokenizer_path(name))
    model.no_truncation()
    model.no_padding()
    model.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
    # Offsets that leave out a token's leading space would leave holes in the mask.
    model.post_processor = processors.ByteLevel(trim_offsets=False)
    return model


def mask(offsets: np.ndarray, spans: np.ndarray, trained: np.ndarray) -> np.ndarray:
    """Which tokens lie in the text of a trained turn.

    ``spans`` are sorted and apart; each token is looked up by binary search for the first turn
    that ends after the token begins.
    """
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    turn = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    inside = turn < len(spans)
    turn = np.minimum(turn, len(spans) - 1)
    inside &= (offsets[:, 1] > spans[turn, 0]) & (offsets[:, 1] > offsets[:, 0])
    return inside & trained[turn]


def masked_texts(formatted: str, offsets: np.ndarray, on: np.ndarray) -> list[str]:
    """The formatted text under the mask, one string for each run of tokens without a gap."""
    out, begin, end = [], None, None
    for a, b in offsets[on].tolist():
        if end is not None and a <= end:
            end = max(end, b)
        else:
            if end is not None:
                out.append(formatted[begin:end])
            begin, end = a, b
    if end is not None:
        out.append(formatted[begin:end])
    return out


def conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation with its turns in order: ``conv_id``, ``turns``.

    Turns are ordered by number (null first), equal numbers by role and text; repeated rows stay.
    Null roles and texts count as empty. A conversation is one training example, so its turns do
    meet in one row; no other conversation's rows do, a null ``conv_id`` is a conversation too.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return (
        rows.select("conv_id", turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))
    )


def format_chats(rows: DataFrame, name: str, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format and encode every conversation of ``conv_id, turn, role, text`` rows.

    Returns ``conv_id``, ``formatted`` (the whole conversation), ``token_ids``, ``starts`` and
    ``ends`` (a token's place in ``formatted``, in code points) and ``loss_mask`` (true for the
    tokens of trained roles' texts, marks excluded). Each conversation is encoded once, whole. An
    empty text has no tokens; an empty table gives no rows; other columns are ignored.
    """
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    schema = (
        f"conv_id {kind}, formatted string, token_ids array<int>, starts array<int>, ends array<int>,"
        " loss_mask array<boolean>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(name)
        for batch in slices(batches, "turns", 1 << 22):
            texts, ids, starts, ends, masks = [], [], [], [], []
            for turns in batch.column("turns").to_pylist():
                text, spans = render([(t["role"], t["text"]) for t in turns])
                encoded = model.encode(text, add_special_tokens=False)
                offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
                trained = np.array([t["role"] in trained_roles for t in turns], bool)
                texts.append(text)
                ids.append(encoded.ids)
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(mask(offsets, spans, trained))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(texts, pa.string()),
                    pa.array(ids, ints),
                    pa.array(starts, ints),
                    pa.array(ends, ints),
                    pa.array(masks, pa.list_(pa.bool_())),
                ],
                ["conv_id", "formatted", "token_ids", "starts", "ends", "loss_mask"],
            )

    return conversations(rows).mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations, one row per conversation."""
    kind = formatted.select("conv_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row in batch.select(["formatted", "starts", "ends", "loss_mask"]).to_pylist():
                text, turns = row["formatted"], read_back(row["formatted"])
                offsets = np.array([row["starts"], row["ends"]], np.int64).reshape(2, -1).T
                loss = "".join(map(unescape, masked_texts(text, offsets, np.array(row["loss_mask"], bool))))
                all_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                values = len(turns), _sha(all_turns), len(loss), _sha(loss), len(text)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id")]
                + [pa.array(v, k) for v, k in zip(out, (long, pa.string(), long, pa.string(), long), strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string,"
        " formatted_chars long",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def control_case(spark) -> DataFrame:
    """Conversation -7: a user and an assistant that both say another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )


