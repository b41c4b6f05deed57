r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as `<turn ROLE>`, a line feed, the text, `</turn>`
and a line feed for each turn.  Inside texts and roles a backslash stands
before each `\` and `<` (in roles before `>` as well), so a text can hold any
control string and reading back restores it.

The rendered text is encoded once, with the character offsets of each token.
The spans of the turns to learn are sorted, as the token spans are; each turn
finds its first and last token by binary search, and the intersections of the
two are the mask.  Tokens that share a character (a letter of several bytes)
hold it once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's tokenizer splits a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A conversation of more code points is rendered and encoded in parts, cut between turns.
PART_CHARS = 1 << 16
TURN = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
PARTS = "conv_id long, part int, last boolean, n_turns int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>, loss array<struct<lo: int, hi: int>>"


def escape(text: str, chars: str = r"\<") -> str:
    return re.sub(f"[{re.escape(chars)}]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], learn: frozenset[str]) -> tuple[str, np.ndarray]:
    """The formatted text and the spans of the (escaped) texts of roles in `learn`."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<turn {escape(role, chr(92) + '<>')}>\n", escape(text)
        if role in learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += head, body, "</turn>\n"
        at += len(head) + len(body) + 8
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def intersect(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Mask of the tokens that touch a span, and the characters of the spans that tokens hold; spans and tokens ascend."""
    mask, loss = np.zeros(len(starts), bool), []
    own = np.maximum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])) if len(starts) else starts
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    for (lo, hi), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        if lo == hi:
            continue
        mask[i:j] = True
        s, e = np.maximum(own[i:j], lo), np.minimum(ends[i:j], hi)
        s, e = s[s < e], e[s < e]
        cut = np.flatnonzero(s[1:] != e[:-1]) + 1
        loss += zip(s[np.concatenate([[0], cut])].tolist(), e[np.concatenate([cut - 1, [len(e) - 1]])].tolist(), strict=True) if len(s) else []
    return mask, loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; ValueError if it is not what render() writes."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := TURN.match(formatted, at)):
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of conv_id, part, last, n_turns, formatted and five arrays, in the columns of PARTS."""
    conv, part, last, n, text, *arrays = zip(*rows, strict=True)

    def lists(x: tuple[np.ndarray, ...]) -> pa.Array:
        bounds = pa.array(np.cumsum([0, *map(len, x)]), pa.int32())
        values = np.concatenate(x)
        inner = pa.array(values) if values.ndim == 1 else pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, 0])), pa.array(np.ascontiguousarray(values[:, 1]))], ["lo", "hi"])
        return pa.ListArray.from_arrays(bounds, inner)

    made = [pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(last, pa.bool_()), pa.array(n, pa.int32()), pa.array(text, pa.string()), *map(lists, arrays)]
    return pa.RecordBatch.from_arrays(made, ["conv_id", "part", "last", "n_turns", "formatted", "ids", "starts", "ends", "mask", "loss"])


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, schema.types, strict=True)], schema=schema)


class Encoder:
    """A byte-level tokenizer from a rank file; control strings in a text are ordinary text."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(token) for token in ranks]
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids and the characters (start and end) that each token holds or has a byte of."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        stop = np.cumsum(self.sizes[ids])
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        begun = np.concatenate([[0], np.cumsum(first)])  # characters that begin before each byte
        return ids, (begun[stop - self.sizes[ids] + 1] - 1).astype(np.int32), begun[stop].astype(np.int32)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """The encoder of a rank file, loaded once in each Python worker."""
    return Encoder(path)


def format_conversations(rows: DataFrame, *, learn: tuple[str, ...] = ("assistant",), tokenizer: str = TOKENIZER, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation in one or, if very long, several parts; columns as in PARTS, parts of a conversation in order within their partition.

    Turns follow each other by turn number (null first); equal ones by role and
    text.  A null role or text is empty; rows with a null conv_id are one
    conversation.  A partition is read as a sorted stream and a part is put out
    when it is full, so no conversation is held whole.  An empty table gives an
    empty one; other columns are not read.  `last` marks a conversation's last part.
    """
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(rows.sparkSession)
    learned = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        held: list[tuple] = []
        conv, part, turns, size = None, 0, [], 0

        def close(last: bool) -> None:
            text, spans = render(turns, learned)
            ids, starts, ends = encoder.encode(text)
            mask, loss = intersect(spans, starts, ends)
            held.append((conv, part, last, len(turns), text, ids, starts, ends, mask, np.array(loss, np.int32).reshape(-1, 2)))

        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if turns and (c != conv or size > PART_CHARS):
                    close(c != conv)
                    part, turns, size = part + 1 if c == conv else 0, [], 0
                conv = c
                turns.append((role, text))
                size += len(text)
            if held:
                yield as_batch(held)
                held = []
        if turns:
            close(True)
            yield as_batch(held)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PARTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what format_conversations() put out, from its output alone.

    Parts may lie anywhere and are parsed where they lie.  A conversation in one
    part is digested there; parts of longer ones are dealt by conv_id, and only
    the running digests go over them in order, as a stream.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans = batch.column("loss")
            bounds = spans.offsets.to_numpy()
            lo, hi = (spans.values.field(x).to_pylist() for x in ("lo", "hi"))
            for k, (conv, part, last, text) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "last", "formatted")), strict=True)):
                turns = read_turns(text)
                said = "".join(f"{role}\n{words}\n" for role, words in turns).encode("utf-8", "surrogatepass")
                masked = unescape("".join(text[lo[x] : hi[x]] for x in range(bounds[k], bounds[k + 1])))
                learned = masked.encode("utf-8", "surrogatepass")
                whole = part == 0 and last
                digests = (hashlib.sha256(said).hexdigest(), hashlib.sha256(learned).hexdigest()) if whole else (None, None)
                out.append((conv, part, len(turns), digests[0], len(masked), digests[1], len(text), None if whole else said, None if whole else learned))
            yield batch_of(out, parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # [conv_id, turns, their digest, loss characters, their digest, characters]

        def finished() -> tuple:
            return tuple(x if x is None or isinstance(x, int) else x.hexdigest() for x in state)

        for batch in batches:
            out = []
            for conv, part, n, turns_digest, chars, loss_digest, size, said, learned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state and part == 0:
                    out.append(finished())
                    state = None
                if said is None:
                    out.append((conv, n, turns_digest, chars, loss_digest, size))
                    continue
                if state is None:
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(said)
                state[3] += chars
                state[4].update(learned)
                state[5] += size
            yield batch_of(out, read)
        if state:
            yield batch_of([finished()], read)

    whole = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    read = pa.schema(whole)
    parsed = pa.schema([whole[0], ("part", pa.int32()), *whole[1:], ("said", pa.binary()), ("learned", pa.binary())])
    ddl = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    small_batches(formatted.sparkSession)
    parts = formatted.select("conv_id", "part", "last", "formatted", "loss").mapInArrow(parse, f"conv_id long, part int, {ddl}, said binary, learned binary")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, f"conv_id long, {ddl}")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(rows.unionByName(more)))


OP7_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(16 + length(regexp_replace(role, '[\\<>]', '__', 'g')) + length(regexp_replace(text, '[\\<]', '__', 'g'))) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
