"""Prefix trie of conversations: a Cartesian tree over the common prefixes of their sorted sequences.

A conversation is the sequence of its turns' 16-byte keys, one binary value, so sorting the values sorts the sequences and
puts prefixes first. Sorted, the nodes of the trie that branch are the intervals of the array of common prefix lengths
between neighbours: each entry reaches to the nearest smaller one on either side. The array is cut into blocks (the
partitions of a range sort). Within a block a stack finds the nearest smaller entries and merges equal ones; intervals that reach over an
edge of the block are left open. All of these contain the block's first or last sequence, so a block leaves
one row: these two sequences, the block's minimum and the open intervals. The same stack goes over these rows and closes them.
Depths at which nothing branches are filled in when a node is closed: their members are those of the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import SPACE_CLASS
from .scratch import materialize

KEY = 16
#: Ids of one sequence are hashed and passed on in pieces of about so many characters; rows of a batch.
PIECE, BATCH = 1 << 20, 4096
_OPEN = pa.struct([("depth", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string())])
_NODE = [("conv_id", pa.int64()), ("depth", pa.int64()), ("id", pa.int64()), ("parent_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_EDGE = [("block", pa.int64()), ("piece", pa.int64()), ("ids", pa.string()), ("at_first", pa.bool_()), ("first_key", pa.binary()), ("first_words", pa.list_(pa.int64())), ("last_key", pa.binary()), ("last_words", pa.list_(pa.int64())), ("left", pa.list_(_OPEN)), ("right", pa.list_(_OPEN))]
_BLOCKS, _CLOSED = pa.schema(_NODE + _EDGE), pa.schema([*_NODE, ("same_as", pa.int64())])
_DDL = "conv_id long, depth long, id long, parent_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_OPEN_DDL = "array<struct<depth:long,id:long,n:long,low:long,children:long,leaves:long,saved:long,ends:string>>"
_BLOCKS_DDL = f"{_DDL}, block long, piece long, ids string, at_first boolean, first_key binary, first_words array<long>, last_key binary, last_words array<long>, left {_OPEN_DDL}, right {_OPEN_DDL}"
NOTHING = hashlib.sha256().hexdigest()


class _Node:
    """An interval: a depth at which something branches or ends, and what is known of its members so far.

    ``same``: ids of nodes of other blocks that are this one; ``hasher``: of the ids that end here, if these come in pieces.
    """

    __slots__ = ("depth", "id", "n", "low", "children", "leaves", "saved", "ends", "hasher", "first", "same")

    def __init__(self, depth: int, id: int, n: int = 0, low: int | None = None, children: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None, first: bool = False):
        self.depth, self.id, self.n, self.low, self.children, self.leaves, self.saved, self.ends = depth, id, n, low, children, leaves, saved, ends
        self.hasher, self.first, self.same = None, first, []

    def take(self, n: int, low: int | None) -> None:
        self.n += n
        if low is not None and (self.low is None or low < self.low):
            self.low = low

    def opened(self) -> dict:
        return {k: getattr(self, k) for k in ("depth", "id", "n", "low", "children", "leaves", "saved", "ends")}


def _common(a: bytes, b: bytes) -> int:
    """Keys that two sequences have in common at their start, by halving."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * KEY : mid * KEY] == b[low * KEY : mid * KEY]:
            low = mid
        else:
            high = mid - 1
    return low


def _closed(node: _Node, parent: _Node, words: list[int]) -> Iterator[dict]:
    """The rows of a node whose members are all known, from its own depth up to below its parent's; what the parent has of it is added there."""
    digest = node.hasher.hexdigest() if node.hasher else node.ends
    leaves, saved, children = node.leaves or 1, node.saved, node.children
    for depth in range(node.depth, parent.depth, -1):
        saved += (node.n - 1) * words[depth - 1]
        own, top = depth == node.depth, depth == parent.depth + 1
        yield {
            "conv_id": node.low, "depth": depth, "id": node.id if own else None, "parent_id": parent.id if top else None, "parent_conv_id": None if top else node.low,
            "n_convs": node.n, "n_children": children if own else 1, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digest if own else None,
        }
    parent.children += 1
    parent.leaves += leaves
    parent.saved += saved


def _pieces(ids: list[int]) -> Iterator[str]:
    """The ids, comma-joined, in order, in strings of bounded size; all but the first begin with the comma."""
    step = PIECE // 20
    for at in range(0, len(ids), step):
        yield ("," if at else "") + ",".join(map(str, ids[at : at + step]))


def _block(rows: Iterator[tuple[bytes, list[int], int]], block: int) -> Iterator[dict]:
    """Nodes of the sorted (sequence, words, conv_id) of one block, and what it leaves open."""
    counter = block << 32
    stack = [_Node(0, counter, first=True)]
    key, words, ids, first, left, group = None, [], [], None, [], 0
    for new_key, new_words, conv in rows:
        if new_key == key:
            stack[-1].take(1, conv)
            ids.append(conv)
            continue
        if key is None:
            first, shared = (new_key, new_words), 0
        else:
            if group == 1:
                yield from ({"block": block, "piece": i, "ids": p, "at_first": True} for i, p in enumerate(_pieces(ids)))
            else:
                stack[-1].ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            shared = _common(key, new_key)
        while stack[-1].depth > shared:
            top = stack.pop()
            if stack[-1].depth < shared:
                counter += 1
                stack.append(_Node(shared, counter, first=top.first))
            stack[-1].take(top.n, top.low)
            if top.first:
                left.append(top)
            else:
                yield from _closed(top, stack[-1], words)
        key, words, ids = new_key, new_words, [conv]
        group += 1
        if len(key) // KEY > stack[-1].depth:
            counter += 1
            stack.append(_Node(len(key) // KEY, counter, first=group == 1))
        stack[-1].take(1, conv)
    if key is None:
        return
    yield from ({"block": block, "piece": i, "ids": p, "at_first": group == 1} for i, p in enumerate(_pieces(ids)))
    for parent, node in zip(stack[-2::-1], stack[:0:-1], strict=True):
        parent.take(node.n, node.low)
    left += [x for x in stack if x.first]
    yield {
        "block": block, "piece": -1, "first_key": first[0], "first_words": first[1], "last_key": key, "last_words": words,
        "left": [x.opened() for x in sorted(left, key=lambda x: x.depth)], "right": [x.opened() for x in stack if not x.first],
    }


class _Path:
    """The open nodes from the root to the last sequence, over the rows that blocks have left, in order."""

    def __init__(self):
        self.stack, self.key, self.words, self.fresh = [], b"", [], -1

    def node(self, opened: dict) -> _Node:
        return _Node(**{k: opened[k] for k in ("depth", "id", "n", "low", "children", "leaves", "saved", "ends")})

    def between(self, depth: int) -> _Node:
        """The open node at a depth, put in where nothing has branched yet: its members are those of the next deeper one."""
        at = next(i for i, x in enumerate(self.stack) if x.depth >= depth)
        below = self.stack[at]
        if below.depth > depth:
            self.stack.insert(at, _Node(depth, self.fresh, below.n, below.low))
            self.fresh -= 1
        return self.stack[at]

    def cut(self, depth: int) -> Iterator[dict]:
        """Close all nodes that are deeper."""
        while self.stack[-1].depth > depth:
            if self.stack[-2].depth < depth:
                self.between(depth)
            top = self.stack.pop()
            yield from self.rows(top, self.stack[-1])

    def rows(self, node: _Node, parent: _Node) -> Iterator[dict]:
        for row in _closed(node, parent, self.words):
            yield row
            if row["id"] is not None:
                yield from ({"conv_id": node.low, "id": other, "same_as": node.id} for other in node.same)

    def enter(self, edge: dict) -> Iterator[dict]:
        """Go on to the first sequence of a block: merge what it shares with the last one, open the rest."""
        left = [self.node(x) for x in edge["left"]]
        if not self.stack:
            self.stack, shared = [left[0]], 0
        else:
            shared = _common(self.key, edge["first_key"])
            yield from self.cut(shared)
            for depth in sorted({x.depth for x in left if x.depth <= shared} | {x.depth for x in self.stack}):
                own, other = self.between(depth), next(x for x in left if x.depth >= depth)
                own.take(other.n, other.low)
                if other.depth == depth:
                    own.children, own.leaves, own.saved, own.ends = own.children + other.children, own.leaves + other.leaves, own.saved + other.saved, own.ends or other.ends
                    own.same.append(other.id)
        self.stack += [x for x in left if x.depth > max(shared, self.stack[-1].depth)]
        self.key, self.words = edge["first_key"], edge["first_words"]

    def leave(self, edge: dict) -> Iterator[dict]:
        """Go on to the last sequence of the block: its minimum is what that shares with the first one."""
        if edge["last_key"] != self.key:
            yield from self.cut(_common(self.key, edge["last_key"]))
            self.stack += [self.node(x) for x in edge["right"]]
            self.key, self.words = edge["last_key"], edge["last_words"]

    def hashed(self, edge: dict) -> None:
        """Ids of the sequence at hand, piece by piece."""
        node = self.stack[-1]
        text = edge["ids"]
        if node.hasher is None:
            node.hasher = hashlib.sha256()
        elif edge["piece"] == 0:
            text = "," + text
        node.hasher.update(text.encode())

    def end(self) -> Iterator[dict]:
        yield from self.cut(0)
        root = self.stack[0]
        yield {
            "conv_id": root.low, "depth": 0, "id": root.id, "n_convs": root.n, "n_children": root.children, "n_leaves": root.leaves or 1, "saved_tokens": root.saved,
            "ends_sha256": root.hasher.hexdigest() if root.hasher else root.ends,
        }
        yield from ({"conv_id": root.low, "id": other, "same_as": root.id} for other in root.same)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(_block(_rows(batches), TaskContext.get().partitionId()), _BLOCKS)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block: its own row first, then ids of its first sequence, then of its last."""

    def run() -> Iterator[dict]:
        path, edge = _Path(), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["piece"] < 0:
                    if edge is not None:
                        yield from path.leave(edge)
                    edge = row
                    yield from path.enter(edge)
                else:
                    if not row["at_first"]:
                        yield from path.leave(edge)
                    path.hashed(row)
        if edge is not None:
            yield from path.leave(edge)
            yield from path.end()

    return _batched(run(), _CLOSED)


def sequences(turns: DataFrame, heads: Callable | None = None) -> DataFrame:
    """(conv_id, key, words) of each conversation: the 16-byte keys of its turns in one value, and their numbers of words.

    Turns are in the order of ``turn``, null first; those of one number by their key. Null roles and texts count as empty. ``heads``: a change of the
    (conv_id, keys, words) arrays before they are joined.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(SPACE_CLASS.replace("[", "[^", 1))).cast("long")
    own = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", key.alias("key"), words.alias("words")).alias("t"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))
    own = heads(own) if heads else own
    return own.select("conv_id", F.unhex(F.array_join(F.transform("keys", lambda k: F.hex(k)), "")).alias("key"), "words")


def prefix_trie(convs: DataFrame) -> DataFrame:
    """All nodes of the trie of the sequences in ``convs`` (conv_id, key, words), as ``sequences`` gives them.

    Returns a row for each distinct sequence of first turns, the empty one included: conv_id (smallest member), depth, parent_conv_id
    (the parent's; null for the root), n_convs (conversations that start with it), n_children, n_leaves (childless nodes in its subtree, itself counted), saved_tokens
    (over its subtree, (n_convs - 1) * words of the last turn), ends_sha256 (of the ascending ids of members that end there, comma-joined).
    conv_ids are distinct and not null. No conversations: no rows, and no root. Conversations are sorted by sequence and id, so that copies of one
    are spread over blocks as well. Each block leaves one row of open nodes (at most twice the turns of a conversation) and the ids of its first and last sequence; these
    rows pass one after another through one task. One conversation is one row of 24 bytes a turn.
    """
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = convs.select("key", "words", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = materialize(dealt.mapInArrow(_blocks, _BLOCKS_DDL), "trie-blocks")
    nodes, edges = found.where("block IS NULL"), found.where("block IS NOT NULL").select(*[c for c, _ in _EDGE])
    order = F.struct(F.col("block"), F.col("piece") >= 0, ~F.coalesce("at_first", F.lit(False)), F.col("piece"))
    closed = materialize(edges.repartition(1).sortWithinPartitions(order).mapInArrow(_edges, f"{_DDL}, same_as long"), "trie-edges")
    names = [c for c, _ in _NODE]
    rows = nodes.select(*names).unionByName(closed.where("same_as IS NULL").select(*names))
    known = nodes.select("id", "conv_id").unionByName(closed.select("id", "conv_id")).where("id IS NOT NULL")
    below = rows.where("parent_id IS NOT NULL").drop("parent_conv_id").join(known.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id")), "parent_id")
    out = rows.where("parent_id IS NULL").unionByName(below)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
