"""The trie of conversations by their first turns, from adaptive radix trees over fixed-width turn ids.

1. A turn becomes WIDTH bytes of a hash of its role and text, a conversation the ids of its turns in a row: its key. Texts
   are read once and not shuffled; only ids and lengths are.
2. Keys are dealt by ranges of (key, conversation), so even one conversation that a third of all rows repeat is spread.
   Each task builds a radix tree of its own keys (`radix_tree`). A path may end within an id; only depths that are
   whole turns are nodes of the trie.
3. Keys are sorted, so only prefixes of a task's first and last key can go on in other tasks. All other nodes are whole, and
   what they add up to hangs on the nearest such border node. Border nodes are summed by the hash of their prefix: two
   paths for each task, however many conversations there are. What the last turns of a path add to the nodes above is a
   running sum along it.

A task holds its share of keys; the ids of the conversations that end in a node pass by in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.lineage import cut
from keyweave.llm.columns import column
from keyweave.llm.radix_tree import Node, bottom_up, build

WIDTH = 16  # bytes of a turn's id: with 2^-128 for two texts, none fall together
PIECE = 1 << 20  # characters of a list of ids that travel in one row, about
ROWS = 20_000  # in a batch
_FOUND = (
    "kind string, node binary, parent binary, task bigint, side int, depth bigint, conv bigint, above bigint, n bigint, "
    "children bigint, leaves bigint, saved bigint, chars bigint, place bigint, ends string"
)
_NAMES = [part.split()[0] for part in _FOUND.split(", ")]
_TYPES = [{"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64()}[part.split()[1]] for part in _FOUND.split(", ")]
_ROOT = hashlib.sha256().digest()[:WIDTH]


def turn_id(role: Column, text: Column) -> Column:
    """The leading bytes of a hash, so byte order is the order of the ids as big-endian numbers."""
    return F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, WIDTH)


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, id, chars) of each turn: its place from 1 in its conversation, its id and the code points of its text.

    Turns are ordered by number, null first; those of one number by their ids. A null role or text is empty. Rows without a
    conversation belong to none. Repeated rows are turns of their own. Other columns are not read.
    """
    text_of = lambda name: F.coalesce(column(name).cast("string"), F.lit(""))
    short = df.where(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv"),
        column(turn).alias("turn"),
        turn_id(text_of(role), text_of(text)).alias("id"),
        F.char_length(text_of(text)).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "id", "chars")
    return short.select("conv", F.row_number().over(order).alias("place"), "id", "chars")


def keys_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, key, chars) of each conversation of `convs` (conv); those without turns have an empty key."""
    lists = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "id", "chars"))).alias("t"))
    joined = convs.join(lists, "conv", "left")
    none = F.array().cast("array<bigint>")
    return joined.select(
        "conv",
        F.coalesce(F.concat_ws("", F.transform("t.id", F.hex)), F.lit("")).alias("key"),
        F.coalesce(F.col("t.chars"), none).alias("chars"),
    ).withColumn("key", F.unhex("key"))


def grafted_turns(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations after each conversation has begun as the first one of its group of ids does.

    Conversation c starts with the first h turns of conversation c - c % group, h being crc32(decimal c) % most (% as in
    SQL, with the sign of c); its own turns after its first h follow. Few turns can be taken over, so the side that all conversations of a group join has
    fewer than `most` rows for each group.
    """
    head = lambda c: F.crc32(c.cast("string").cast("binary")) % most
    convs = turns.select("conv").distinct()
    taken = turns.where(f"conv % {group} = 0 AND place < {most}").select(F.col("conv").alias("base"), "place", "id", "chars")
    heads = convs.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), head(F.col("conv")).alias("h"))
    first = heads.join(taken, "base").where("place <= h").select("conv", "place", "id", "chars")
    own = turns.where(F.col("place") > head(F.col("conv")))
    return first.unionByName(own), convs


@dataclass
class _Found:
    """Rows of a task on their way out."""

    rows: list[tuple] = field(default_factory=list)

    def add(self, kind: str, **values) -> None:
        self.rows.append((kind, *[values.get(name) for name in _NAMES[1:]]))

    def batches(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_ or len(self.rows) >= ROWS):
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)
            self.rows.clear()


def _pieces(ids: list[int]) -> Iterator[tuple[int, str]]:
    """Ids in rising order as texts of about PIECE characters, each with its first id."""
    for k in range(0, len(ids), PIECE // 10):
        part = ids[k : k + PIECE // 10]
        yield part[0], ",".join(map(str, part))


def _turns(node: Node) -> tuple[int, int]:
    """The first and last turn that end on the node's path; the last is before the first if none does."""
    return node.start // WIDTH + 1, node.end // WIDTH


def _sum_up(node: Node, last_row: int, keys: list[bytes], chars: list, convs: list[int]) -> None:
    """Set `sums`: members, least member, whole children, leaves and saved tokens below the deepest turn of its path, and
    the same three as seen from above its path."""
    below = list(node.children())
    n = len(node.ends) + sum(c.sums[0] for c in below)
    least = min([*(convs[row] for row in node.ends[:1]), *(c.sums[1] for c in below)])
    children, leaves, saved = (sum(c.sums[5 + i] for c in below) for i in range(3))
    border = node.first == 0 or node.last == last_row
    first_turn, last_turn = _turns(node)
    seen = (children, leaves, saved)
    if last_turn >= first_turn:
        if border:
            seen = (0, 0, 0)  # a border node is counted when all tasks' shares are summed
        else:
            seen = (1, leaves or 1, saved + (n - 1) * sum(chars[node.first][first_turn - 1 : last_turn]))
    node.sums = (n, least, children, leaves, saved, *seen)


def _prefix_hashes(key: bytes) -> list[bytes]:
    """The name of the node of each number of leading turns."""
    state, found = hashlib.sha256(), [_ROOT]
    for k in range(0, len(key), WIDTH):
        state.update(key[k : k + WIDTH])
        found.append(state.copy().digest()[:WIDTH])
    return found


def _nodes(keys: list[bytes], chars: list, convs: list[int]) -> Iterator[pa.RecordBatch]:
    """Whole nodes, shares of border nodes and the pieces of their lists of ids, of a task's sorted keys."""
    top = build(keys)
    if top is None:
        return
    last_row, found, task = len(keys) - 1, _Found(), convs[0]
    names = {0: _prefix_hashes(keys[0]), 1: _prefix_hashes(keys[last_row])}
    for node in bottom_up(top):
        _sum_up(node, last_row, keys, chars, convs)
    shared = 0  # turns on both paths
    stack: list[tuple[Node, int | None, bytes | None]] = [(top, None, None)]  # node, parent's least member if known here, else its name
    while stack:
        node, above, above_name = stack.pop()
        n, least, children, leaves, saved = node.sums[:5]
        side = 0 if node.first == 0 else 1 if node.last == last_row else None
        first_turn, last_turn = _turns(node)
        own_chars = chars[node.first][first_turn - 1 : last_turn]
        if node is top:
            first_turn, own_chars = 0, [0]  # the root has no text
        sums, total = [], saved
        for c in reversed(own_chars):
            total += (n - 1) * c
            sums.append(total)
        for depth in range(first_turn, last_turn + 1):
            deepest = depth == last_turn
            ends = [convs[row] for row in node.ends] if deepest else []
            if side is None:
                inner = 1 if not deepest else children
                digest = hashlib.sha256()
                for _, piece in _joined(ends):
                    digest.update(piece.encode())
                found.add(
                    "whole", conv=least, depth=depth, above=above, parent=above_name, n=n, children=inner, leaves=leaves or 1,
                    saved=sums[last_turn - depth], ends=digest.hexdigest(),
                )
                above, above_name = least, None
            else:
                name = names[side][depth]
                found.add(
                    "border", node=name, parent=names[side][depth - 1] if depth else None, task=task, side=side, depth=depth, conv=least, n=n,
                    children=children if deepest else 0, leaves=leaves if deepest else 0, saved=saved if deepest else 0,
                    chars=own_chars[depth - first_turn],
                )
                for place, piece in _pieces(ends):
                    found.add("ends", node=name, place=place, ends=piece)
                if node.first == 0 and node.last == last_row:
                    shared = max(shared, depth)
                above, above_name = None, name
            yield from found.batches()
        stack.extend((c, above, above_name) for c in node.children())
    if last_row:
        for depth in range(shared + 1):  # the second path is whole, too; these nodes have their sums in the first
            found.add("border", node=names[1][depth], task=task, side=1, depth=depth, n=0, children=0, leaves=0, saved=0)
    yield from found.batches(all_=True)


def _joined(ids: list[int]) -> Iterator[tuple[int, str]]:
    """As `_pieces`, with the commas between them."""
    for k, (place, piece) in enumerate(_pieces(ids)):
        yield place, f",{piece}" if k else piece


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, chars, convs = [], [], []
    for batch in batches:
        convs += batch.column(0).to_pylist()
        keys += batch.column(1).to_pylist()
        chars += batch.column(2).to_pylist()
    yield from _nodes(keys, chars, convs)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sha256) from pieces sorted by node and place; one state at a time is held."""
    node, state = None, None
    for batch in batches:
        rows = []
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if name != node:
                if node is not None:
                    rows.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])


def _border_nodes(found: DataFrame) -> DataFrame:
    """(node, parent, depth, conv, n, children, leaves, saved) of the nodes that several tasks may share, summed up."""
    shares = found.where("kind = 'border'")
    # The first path that holds a node counts for it, once.
    path = F.struct("task", "side")
    summed = shares.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("chars").alias("chars"), F.min(path).alias("owner"),
    )
    summed = cut(summed, "border-nodes")
    kids = summed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    own = summed.join(kids, "node", "left").withColumn("children", F.col("children") + F.coalesce("kids", F.lit(0)))
    own = own.withColumn("leaves", F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0))
    own = cut(own.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("chars")).drop("kids"), "border-sums")
    along = shares.select("node", "depth", path.alias("path")).join(own.select("node", "owner", "leaves", "saved"), "node")
    upward = Window.partitionBy("path").orderBy(F.desc("depth"))
    is_own = F.col("path") == F.col("owner")
    carried = along.select(
        "node",
        *[F.sum(F.when(is_own, F.col(c)).otherwise(0)).over(upward).alias(c) for c in ("leaves", "saved")],
    )
    totals = carried.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    return own.drop("leaves", "saved", "owner", "chars").join(totals, "node")


def trie_nodes(keys: DataFrame) -> DataFrame:
    """One row for each distinct sequence of leading turns of the keys (conv, key, chars), conversations given once each.

    conv_id: the least member; depth; parent_conv_id; n_convs, n_children, n_leaves, saved_tokens; ends_sha256. Conversations
    without turns are members of the root alone. Without conversations there are no rows.
    """
    partitions = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(keys.select("conv", "key", "chars"), "keys")  # ranges are taken from a sample, and from the same rows again after a loss
    dealt = keys.repartitionByRange(partitions, "key", "conv").sortWithinPartitions("key", "conv")
    found = cut(dealt.mapInArrow(_grow, _FOUND), "trie")
    border = cut(_border_nodes(found), "border")
    pieces = found.where("kind = 'ends'").select("node", "place", "ends").repartition("node").sortWithinPartitions("node", "place")
    digests = pieces.mapInArrow(_digests, "node binary, ends_sha256 string")
    least = border.select(F.col("node").alias("parent"), F.col("conv").alias("least"))
    whole = found.where("kind = 'whole'")
    no_ends = F.lit(hashlib.sha256().hexdigest())
    at_border = border.join(least, "parent", "left").join(digests, "node", "left")
    figures = ["n", "children", "leaves", "saved"]
    inside = whole.where("parent IS NULL").select("conv", "depth", F.col("above").alias("parent"), *figures, "ends")
    below = whole.join(least, "parent").select("conv", "depth", F.col("least").alias("parent"), *figures, "ends")
    rows = inside.union(below).union(
        at_border.select("conv", "depth", F.col("least").alias("parent"), *figures, F.coalesce("ends_sha256", no_ends))
    )
    return rows.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`trie_nodes` of the conversations as they are; nulls, ties and repeated rows as in `turns_of`."""
    turns = cut(turns_of(df, conv, turn, role, text), "turns")
    return trie_nodes(keys_of(turns, turns.select("conv").distinct()))


def grafted_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`trie_nodes` of the conversations after `grafted_turns`."""
    turns = cut(turns_of(df, conv, turn, role, text), "turns")
    return trie_nodes(keys_of(*grafted_turns(turns)))
