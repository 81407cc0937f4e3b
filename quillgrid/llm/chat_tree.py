"""Conversations as prefix trees: turns that conversations begin with alike are written once.

Conversations are ordered by the digests of their turns, which is the depth-first order
of their tree, and cut into packs (the partitions of that order) so that a first turn
shared by a third of all conversations spreads over many packs. A pack lists each node
once, before its children: where its characters stand in the pack, the position ids they
start at (the characters before it on its own path), and the intervals of the pack that
it may attend to, which are its ancestors. The unit is the code point.

The template is `### role: text</turn>` and a line break. Inside texts and roles the
characters backslash, `#` and `<` become backslash pairs without them, so no control
string can stand in a text, and the text is read back exactly. The loss mask covers the
text of assistant turns.

Defined results: null texts and roles count as empty; turns that share a number stand in
order of role and text, null numbers first; rows without a conversation id are one
conversation; a conversation with no rows does not exist; an empty table gives no packs.
Turns of one conversation are streamed in order, never gathered. Beyond the 64th turn
conversations share nodes only with their neighbours in the order. Only the four named
columns are read.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ORDER_TURNS = 64
HEAD, BREAK, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
PLAIN = {code[1]: char for char, code in ESCAPES.items()}
IN_TEXT, IN_ROLE, CODE = re.compile(r"[\\#<]"), re.compile(r"[\\#<:\n]"), re.compile(r"\\(.)")
LOSS_ROLE = "assistant"

CHAINED_SCHEMA = "conv_id long, step long, sort_key binary, path binary, role string, text string"
PACK_SCHEMA = (
    "pack long, seq long, kind string, node long, parent long, start long, position long, length long, "
    "attends array<struct<start:long,end:long>>, formatted string, loss_start long, loss_end long, conv_id long"
)
READ_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escaped(text: str, characters: re.Pattern) -> str:
    return characters.sub(lambda m: ESCAPES[m[0]], text)


def unescaped(text: str) -> str:
    return CODE.sub(lambda m: PLAIN[m[1]], text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends in it."""
    head = HEAD + escaped(role, IN_ROLE) + BREAK
    body = escaped(text, IN_TEXT)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parsed_turn(formatted: str) -> tuple[str, str]:
    head, body = formatted[len(HEAD) : -len(CLOSE)].split(BREAK, 1)
    return unescaped(head), unescaped(body)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def chained(rows: Iterator[dict]) -> Iterator[dict]:
    """Adds step, the digest of all turns so far, and the conversation's place in depth-first order."""
    waiting: list[dict] = []
    current, step, path, sort_key = object(), 0, b"", b""

    def released() -> Iterator[dict]:
        for row in waiting:
            yield row | {"sort_key": sort_key}
        waiting.clear()

    for row in rows:
        if row["conv_id"] != current:
            yield from released()
            current, step, path, sort_key = row["conv_id"], 0, b"", b""
        digest = hashlib.blake2b(path, digest_size=16)
        for part in (row["role"].encode(), row["text"].encode()):
            digest.update(len(part).to_bytes(8, "big") + part)
        path = digest.digest()
        if step < ORDER_TURNS:
            sort_key += path[:8]
        waiting.append({"conv_id": current, "step": step, "path": path, "role": row["role"], "text": row["text"]})
        step += 1
        if step >= ORDER_TURNS:
            yield from released()
    yield from released()


@dataclass
class Open:
    """A node on the path last written: what its children need to know."""

    path: bytes
    node: int
    end_position: int
    seen: list[dict]


def packed(rows: Iterator[dict], pack: int) -> Iterator[dict]:
    """Nodes in depth-first order, and after its last node each conversation's pointer to it."""
    stack: list[Open] = []
    nodes = offset = seq = 0
    current, leaf = None, None
    for row in rows:
        if row["step"] == 0 and leaf is not None:
            yield {"pack": pack, "seq": seq, "kind": "conversation", "node": leaf, "conv_id": current}
            seq += 1
        current, step = row["conv_id"], row["step"]
        if step >= len(stack) or stack[step].path != row["path"]:
            del stack[step:]
            above = stack[-1] if stack else None
            formatted, text_start, text_end = formatted_turn(row["role"], row["text"])
            loss = row["role"] == LOSS_ROLE
            attends = above.seen if above else []
            position = above.end_position if above else 0
            end = offset + len(formatted)
            yield {
                "pack": pack, "seq": seq, "kind": "node", "node": nodes, "parent": above.node if above else None,
                "start": offset, "position": position, "length": len(formatted), "attends": attends,
                "formatted": formatted, "loss_start": offset + text_start if loss else None,
                "loss_end": offset + text_end if loss else None,
            }
            # Ancestors written one after the other make one interval.
            joined = attends and attends[-1]["end"] == offset
            seen = [*attends[:-1], {"start": attends[-1]["start"], "end": end}] if joined else [*attends, {"start": offset, "end": end}]
            stack.append(Open(row["path"], nodes, position + len(formatted), seen))
            nodes, offset, seq = nodes + 1, end, seq + 1
        leaf = stack[step].node
    if leaf is not None:
        yield {"pack": pack, "seq": seq, "kind": "conversation", "node": leaf, "conv_id": current}


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def prefix_trees(
    conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The packs: rows of kind node and conversation, ordered by seq within each pack."""
    chain_schema, pack_schema = arrow_schema(CHAINED_SCHEMA), arrow_schema(PACK_SCHEMA)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(chained(rows_of(batches)), chain_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(packed(rows_of(batches), TaskContext.get().partitionId()), pack_schema)

    blank = F.lit("")
    turns = conversations.select(
        F.col(key).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"),
        F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    )
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = turns.drop("turn").mapInArrow(chain, CHAINED_SCHEMA)
    rows = rows.repartitionByRange("sort_key", "conv_id").sortWithinPartitions("sort_key", "conv_id", "step")
    return rows.mapInArrow(pack, PACK_SCHEMA)


class Reader:
    """What the path to a node says: running digests, so a conversation's text is never held."""

    def __init__(self):
        self.turns, self.all = 0, hashlib.sha256()
        self.loss_chars, self.loss, self.chars = 0, hashlib.sha256(), 0

    def after(self, node: dict) -> "Reader":
        grown = Reader()
        grown.turns, grown.all, grown.loss = self.turns + 1, self.all.copy(), self.loss.copy()
        role, text = parsed_turn(node["formatted"])
        grown.all.update(f"{role}\n{text}\n".encode())
        grown.loss_chars, grown.chars = self.loss_chars, self.chars + node["length"]
        if node["loss_start"] is not None:
            masked = unescaped(node["formatted"][node["loss_start"] - node["start"] : node["loss_end"] - node["start"]])
            grown.loss.update(masked.encode())
            grown.loss_chars += len(masked)
        return grown


def read_rows(rows: Iterator[dict]) -> Iterator[dict]:
    path: list[tuple[int, Reader]] = []
    for row in rows:
        if row["kind"] == "node":
            if row["parent"] is None:
                path = []
            while path and path[-1][0] != row["parent"]:
                path.pop()
            path.append((row["node"], (path[-1][1] if path else Reader()).after(row)))
        else:
            state = next(r for n, r in reversed(path) if n == row["node"])
            yield {
                "conv_id": row["conv_id"], "n_turns": state.turns, "turns_sha256": state.all.hexdigest(),
                "loss_chars": state.loss_chars, "loss_sha256": state.loss.hexdigest(), "formatted_chars": state.chars,
            }


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone: what its turns and its loss mask say."""
    schema = arrow_schema(READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition may hold several packs; each starts with a root, which resets the path.
        return in_batches(read_rows(rows_of(batches)), schema)

    needed = packs.select("pack", "seq", "kind", "node", "parent", "start", "length", "formatted", "loss_start", "loss_end", "conv_id")
    return needed.repartition("pack").sortWithinPartitions("pack", "seq").mapInArrow(read, READ_SCHEMA)
