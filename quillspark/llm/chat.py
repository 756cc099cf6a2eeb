"""Chat formatting at token level.

Each turn is encoded by itself: its text is escaped, encoded with no special token
known to the tokenizer, and the template's reserved ids are spliced around it, so no
text can ever turn into a control token. The loss mask comes from prefix sums of +1
where a trained segment begins and -1 after it ends. Turns are encoded where they
are read; only ids and masks are shuffled, to bring a conversation's turns together
in order. No step holds more than one turn, however long a conversation is.

Template (each mark is one reserved id):

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>              text and </s> carry loss
    any other  [ROLE] role [/ROLE] text </s>

Escaping doubles backslashes and puts ``\\_`` after the first character of every
control string that occurs in a text; it is undone exactly by ``unescape``.

Defined results: null texts and roles are empty; a null conversation id is one
conversation; turns go by turn, null first, and equal turns by role, then ids;
repeated rows are turns like any other; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File of byte-level ranks; a parameter of every function that encodes or decodes.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern that goes with these ranks.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The template's marks; their ids follow the vocabulary in this order.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
FIRST_MARK = 50_257
BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE = range(FIRST_MARK, FIRST_MARK + len(MARKS))
LOSS_ROLES = ("assistant",)
#: Longest run of text given to the tokenizer at once.
PIECE = 1 << 16
_CONTROL = re.compile("|".join(map(re.escape, sorted(MARKS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\|_)")
_LONG_RUN = re.compile(r"\S{4000}")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\_{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


@functools.cache
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    """Ids of an escaped text; runs too long to split are cut, which still decodes exactly."""
    enc, step = tokenizer(path), 1000 if _LONG_RUN.search(text) else PIECE
    if len(text) <= step:
        return enc.encode_ordinary(text)
    return [i for at in range(0, len(text), step) for i in enc.encode_ordinary(text[at:at + step])]


def turn_ids(role: str | None, text: str | None, path: str, loss_roles=LOSS_ROLES) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    role, body = role or "", encode(escape(text or ""), path)
    if role == "system":
        head, tail = [SYS], [END_SYS]
    elif role == "user":
        head, tail = [INST], [END_INST]
    elif role == "assistant":
        head, tail = [BOS], [EOS]
    else:
        head, tail = [ROLE, *encode(escape(role), path), END_ROLE], [EOS]
    ids = np.array([*head, *body, *tail], np.int32)
    edges = np.zeros(len(ids) + 1, np.int8)
    if role in loss_roles:
        edges[len(head)] += 1
        edges[len(ids)] -= 1
    return ids, np.cumsum(edges)[:-1].astype(np.int8)


def parse(ids: np.ndarray, path: str) -> tuple[str, str, int]:
    """Role, text and characters as formatted, read back from one turn's ids."""
    enc = tokenizer(path)
    at = np.nonzero(ids >= FIRST_MARK)[0]
    marks = ids[at].tolist()
    pieces = [enc.decode_bytes(ids[a + 1:b].tolist()).decode("utf-8") for a, b in zip(at, at[1:], strict=False)]
    chars = sum(map(len, pieces)) + sum(len(MARKS[m - FIRST_MARK]) for m in marks)
    if marks == [ROLE, END_ROLE, EOS]:
        return unescape(pieces[0]), unescape(pieces[1]), chars
    role = {(SYS, END_SYS): "system", (INST, END_INST): "user", (BOS, EOS): "assistant"}[tuple(marks)]
    return role, unescape(pieces[0]), chars


def masked_text(ids: np.ndarray, mask: np.ndarray, path: str) -> str:
    """The text under a turn's loss mask, unescaped."""
    kept = ids[(mask > 0) & (ids < FIRST_MARK)]
    return unescape(tokenizer(path).decode_bytes(kept.tolist()).decode("utf-8"))


def format_turns(conversations: DataFrame, path: str = TOKENIZER, loss_roles=LOSS_ROLES) -> DataFrame:
    """conv_id, turn, role, ids, loss_mask: a row a turn, a conversation's rows together and in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [turn_ids(r, t, path, loss_roles) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)]
            offsets = pa.array(np.cumsum([0, *(len(i) for i, _ in got)]).astype(np.int32))
            none = np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([i for i, _ in got] or [none]).astype(np.int32)))
            mask = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m for _, m in got] or [none]).astype(np.int8)))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), ids, mask], ["conv_id", "turn", "role", "ids", "loss_mask"])

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")
    done = rows.mapInArrow(run, "conv_id long, turn long, role string, ids array<int>, loss_mask array<byte>")
    return done.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids")


def read_back(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row a conversation, from ``format_turns`` as it stands: digests of what the ids say."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        now = None  # (conv_id, digest of turns, digest of loss text, counts)

        def row(x):
            _, turns_, loss, n = x
            return (x[0], n["turns"], turns_.hexdigest(), n["loss_chars"], loss.hexdigest(), n["chars"], n["tokens"], n["loss_tokens"])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        for b in batches:
            out = []
            ids_col, mask_col = b.column("ids"), b.column("loss_mask")
            for k, conv in enumerate(b.column("conv_id").to_pylist()):
                ids = ids_col[k].values.to_numpy(zero_copy_only=False)
                mask = mask_col[k].values.to_numpy(zero_copy_only=False)
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(row(now))
                    now = (conv, hashlib.sha256(), hashlib.sha256(), dict.fromkeys(("turns", "loss_chars", "chars", "tokens", "loss_tokens"), 0))
                role, text, chars = parse(ids, path)
                now[1].update(f"{role}\n{text}\n".encode())
                trained = masked_text(ids, mask, path) if mask.any() else ""
                now[2].update(trained.encode())
                for name, more in (("turns", 1), ("loss_chars", len(trained)), ("chars", chars), ("tokens", len(ids)), ("loss_tokens", int(mask.sum()))):
                    now[3][name] += more
            if out:
                yield batch(out)
        if now is not None:
            yield batch([row(now)])

    return turns.mapInArrow(run, schema)


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(turns)).drop("n_tokens", "loss_tokens")


#: The same from the texts themselves: what was formatted must read back as it was.
OP1_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
e AS (SELECT *, len(text) + len(text) - len(replace(text, '\', '')) + 2 * len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\]')) AS escaped FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + len(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
