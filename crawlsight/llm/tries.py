"""The trie of conversations: what they share from their first turn on, and what storing shared turns once would save.

1. A turn becomes a 16-byte digest of its role and text and a word count; texts go no further. A rebuilt conversation is
   the sequence of its digests. In the order of these sequences a trie is walked depth first.
2. Conversations are cut into shards, ranges of (sequence, conv_id), so conversations that a third of all rows equal lie
   in many shards. Each shard is told the last sequence before it and the first one after it.
3. A shard writes its trie as balanced parentheses. Range minima over blocks of the excess find the closing parenthesis
   of each node, which delimits its subtree; ranks of leaf pairs count leaves, prefix sums over the preorder give savings.
4. Only nodes on the way to a shard's neighbours (its spines) can be in several shards. A shard counts a spine node's
   words, leaves and children once for all shards, as the neighbours show whether it was seen before or goes on, so that
   sums over shards are exact. Members that end at a spine node are hashed as a stream of chunks in order.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import stored

#: Turns in a shard, about.
TURNS = 1_000_000
#: Members in a chunk of a spine node's list.
CHUNK = 1 << 16
DIGEST = 16
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PIECE = f"shard long, node_id binary, parent_id binary, {NODE}, chunk long, ids binary"


class Parens:
    """Balanced parentheses (1 opens) with the minimum excess of every block, and of pairs of blocks up to all."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray) -> None:
        self.excess = np.cumsum(2 * bits.astype(np.int32) - 1, dtype=np.int32)
        far = np.iinfo(np.int32).max
        padded = np.full(-(-len(bits) // self.BLOCK) * self.BLOCK, far, np.int32)
        padded[: len(bits)] = self.excess
        self.lows = [padded.reshape(-1, self.BLOCK).min(1)]
        while len(self.lows[-1]) > 1:
            low = self.lows[-1]
            if len(low) % 2:
                low = self.lows[-1] = np.append(low, far)
            self.lows.append(low.reshape(-1, 2).min(1))

    def _scan(self, at: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place from ``at`` to its block's end where the excess is at most ``below``, and whether there is."""
        at, done = at.copy(), np.zeros(len(at), bool)
        todo = np.flatnonzero(at < len(self.excess))
        while len(todo):
            hit = self.excess[at[todo]] <= below[todo]
            done[todo[hit]] = True
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[(at[todo] % self.BLOCK != 0) & (at[todo] < len(self.excess))]
        return at, done

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The closing parentheses of ``opens``: the first later place with less excess."""
        below = self.excess[opens] - 1
        at, done = opens + 1, np.zeros(len(opens), bool)
        inside = at % self.BLOCK != 0  # else the next block is entered at its start
        at[inside], done[inside] = self._scan(at[inside], below[inside])
        far = np.flatnonzero(~done)
        if len(far):
            block, level = -(-at[far] // self.BLOCK), np.full(len(far), -1)
            for k, low in enumerate(self.lows):  # up: a right child, or the top, may hold it; otherwise ask above
                asked = np.flatnonzero((level < 0) & ((block % 2 == 1) | (k == len(self.lows) - 1)))
                found = asked[low[np.minimum(block[asked], len(low) - 1)] <= below[far[asked]]]
                level[found] = k
                rest = level < 0
                block[rest] = (block[rest] + 1) // 2
            for k in range(len(self.lows) - 1, 0, -1):  # down: the left child if it goes that low
                here = level == k
                left = 2 * block[here]
                block[here] = np.where(self.lows[k - 1][left] <= below[far[here]], left, left + 1)
                level[here] = k - 1
            at[far], _ = self._scan(block * self.BLOCK, below[far])
        return at


def common_prefix(a: bytes | None, b: bytes) -> int:
    """Turns at the start of both sequences; -1 without the first."""
    if a is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(s, np.uint64, 2 * n).reshape(-1, 2) for s in (a, b))
    differ = np.flatnonzero((x != y).any(1))
    return int(differ[0]) if len(differ) else n


def adjacent_prefixes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each sequence the number of first turns that it has in common with the one before it; 0 for the first."""
    least = np.minimum(lengths[:-1], lengths[1:])
    which = np.repeat(np.arange(len(least)), least)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(least) - least, least)
    differ = np.flatnonzero((flat[starts[:-1][which] + inside] != flat[starts[1:][which] + inside]).any(1))
    np.minimum.at(least, which[differ], inside[differ])
    return np.concatenate([[0], least])


def path_ids(seq: bytes, depth: int) -> list[bytes]:
    """Names of the nodes at depths 0 to ``depth`` on the way to ``seq``."""
    h = hashlib.sha256()
    out = [h.digest()[:DIGEST]]
    for d in range(depth):
        h.update(seq[d * DIGEST : (d + 1) * DIGEST])
        out.append(h.copy().digest()[:DIGEST])
    return out


def shard_nodes(shard: int, seqs: list[bytes], words: np.ndarray, convs: np.ndarray, before: bytes | None, after: bytes | None) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard's trie, and chunks of the members that end at its spine nodes.

    ``seqs`` and ``convs`` are in order, ``words`` are the turns' word counts one conversation after the other.
    """
    n_rows, lengths = len(seqs), np.array([len(s) // DIGEST for s in seqs])
    starts = np.cumsum(lengths) - lengths
    lcp = adjacent_prefixes(np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2), starts, lengths)
    opened = lengths - lcp
    closed = np.append(np.concatenate([[0], lengths[:-1]]) - lcp, lengths[-1] + 1)
    opened_at = np.append(opened, 0)
    # root, then for each conversation what it closes and what it opens
    bits = np.concatenate([[1], np.repeat(np.tile([0, 1], n_rows + 1), np.stack([closed, opened_at], 1).ravel())]).astype(np.uint8)
    row_at = np.concatenate([[0], np.repeat(np.arange(n_rows + 1), closed + opened_at)])
    parens, opens = Parens(bits), np.flatnonzero(bits)
    closes = parens.find_close(opens)

    n = len(opens)
    row = row_at[opens]
    row[0] = 0
    first = np.cumsum(opened) - opened + 1  # the first node that a conversation opens
    depth = np.concatenate([[0], np.arange(1, n) - first[row[1:]] + lcp[row[1:]] + 1])
    weight = np.concatenate([[0], words[starts[row[1:]] + depth[1:] - 1]]).astype(np.int64)
    row_end = row_at[closes]
    row_end[0] = n_rows
    last = (np.cumsum(bits) - 1)[closes] + 1  # in preorder, the first node behind the subtree
    n_convs = row_end - row
    least = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), np.stack([row, row_end], 1).ravel())[::2]

    # of the way to the neighbours
    seen, goes_on = common_prefix(before, seqs[0]), common_prefix(after, seqs[-1])
    old = (row == 0) & (depth <= seen)
    on_first, on_last = old, (row_end == n_rows) & (depth <= goes_on)
    spine = on_first | on_last

    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    saved = sums(n_convs * weight - np.where(old, 0, weight))
    leaf = bits[opens + 1] == 0
    if after is not None and goes_on == lengths[-1]:
        leaf[-1] = False  # the last path goes on in the next shard, which counts its leaf
    leaves = sums(leaf)
    order = np.argsort(depth, kind="stable")
    keys = depth[order] * (n + 1) + order
    parent = np.arange(-1, n - 1)
    heads = first[opened > 0]
    parent[heads] = order[np.searchsorted(keys, (depth[heads] - 1) * (n + 1) + heads) - 1]
    children = np.bincount(parent[1:][~old[1:]], minlength=n)

    ids = np.full(n, None, object)
    for on, seq, reach in ((on_first, seqs[0], seen), (on_last, seqs[-1], goes_on)):
        at = np.flatnonzero(on)
        if len(at):
            names = path_ids(seq, reach)
            for k, d in zip(at.tolist(), depth[at].tolist(), strict=True):
                ids[k] = names[d]

    # members that end at a node lie side by side, in the order of their ids
    ends = np.cumsum(opened)
    sha = np.full(n, NOBODY, object)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1, [n_rows]])
    chunks = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        k = int(ends[a])
        if ids[k] is None:
            sha[k] = hashlib.sha256(",".join(map(str, convs[a:b].tolist())).encode()).hexdigest()
        else:
            sha[k] = None
            chunks += [(ids[k], c, zlib.compress(np.diff(convs[c : min(c + CHUNK, b)], prepend=0).astype("<i8").tobytes())) for c in range(a, b, CHUNK)]

    up = np.maximum(parent, 0)
    parent_ids = np.where(parent >= 0, ids[up], None)
    parent_conv = pa.array(least[up], pa.int64(), mask=(parent < 0) | np.not_equal(parent_ids, None))
    long = lambda x: pa.array(x, pa.int64())
    nodes = [long(np.full(n, shard)), pa.array(ids, pa.binary()), pa.array(parent_ids, pa.binary()), long(least), long(depth), parent_conv, long(n_convs), long(children), long(leaves[last] - leaves[:-1]), long(saved[last] - saved[:-1]), pa.array(sha, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    names = [c.split()[0] for c in PIECE.split(", ")]
    table = pa.RecordBatch.from_arrays(nodes, names)
    for a in range(0, n, 10_000):
        yield table.slice(a, 10_000)
    for node_id, c, packed in chunks:
        columns = {"shard": long([shard]), "node_id": pa.array([node_id], pa.binary()), "chunk": long([c]), "ids": pa.array([packed], pa.binary())}
        empty = {f: pa.nulls(1, table.schema.field(f).type) for f in names}
        yield pa.RecordBatch.from_pydict(empty | columns)


def rebuilt(conversations: DataFrame, family: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, seq (16 bytes a turn), words (of each turn): every conversation with the first h turns of its family's
    first conversation in the place of its own first h, h being crc32(conv_id) % ``shared``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    n_words = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    conv = F.col("conv_id").cast("long")
    turns = conversations.filter(conv.isNotNull()).select(conv.alias("conv_id"), (conv - conv % family).alias("base"), F.struct("turn", digest.alias("digest"), n_words.alias("words")).alias("t"))
    # one shuffle: a family's conversations lie together
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, shared - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    whole = own.withColumns({"head": head, "h": h}).withColumn(
        "turns", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), F.slice("turns", F.col("h") + 1, F.size("turns")))
    )
    seq = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    return whole.select("conv_id", seq.alias("seq"), F.transform("turns", lambda x: x["words"]).alias("words"))


def shards_of(sequences: DataFrame) -> DataFrame:
    """shard, kind, seq, conv_id, words in order: the neighbour's last sequence (kind 0), the shard's conversations (1),
    the next shard's first sequence (2)."""
    least = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sequences.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    parts = max(least, math.ceil(total / TURNS))
    placed = stored(sequences.repartitionByRange(parts, "seq", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")), "trie-shards")
    edges = placed.groupBy("shard").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    along = Window.orderBy("shard")
    near = edges.select("first", "last", F.lag("shard").over(along).alias("previous"), F.lead("shard").over(along).alias("next"))
    nobody = [F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("array<int>").alias("words")]
    marks = near.select(F.explode(F.array(F.struct(F.col("next").alias("shard"), F.lit(0).alias("kind"), F.col("last").alias("seq")), F.struct(F.col("previous").alias("shard"), F.lit(2).alias("kind"), F.col("first").alias("seq")))).alias("m"))
    marks = marks.filter("m.shard is not null").select("m.shard", "m.kind", "m.seq", *nobody)
    rows = placed.select("shard", F.lit(1).alias("kind"), "seq", "conv_id", "words").unionByName(marks)
    return rows.repartition(parts, "shard").sortWithinPartitions("shard", "kind", "seq", "conv_id")


def trie_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`shards_of`, one shard after the other, to the nodes of each."""

    def whole(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        kind, seqs = table.column("kind").to_numpy(), table.column("seq").to_pylist()
        inside = np.flatnonzero(kind == 1)
        if len(inside):
            a, b = int(inside[0]), int(inside[-1]) + 1
            words = table.column("words").slice(a, b - a).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            convs = table.column("conv_id").slice(a, b - a).to_numpy()
            yield from shard_nodes(shard, seqs[a:b], words, convs, seqs[0] if kind[0] == 0 else None, seqs[-1] if kind[-1] == 2 else None)

    current, parts = None, []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]]) if len(shards) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if parts and shards[a] != current:
                yield from whole(current, parts)
                parts = []
            current = int(shards[a])
            parts.append(batch.slice(int(a), int(b - a)))
    if parts:
        yield from whole(current, parts)


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of node and ids to one hash per node; of a node only the state of its hash is kept."""
    node, state, out = None, None, []
    for batch in batches:
        for node_id, packed in zip(batch.column("node_id").to_pylist(), batch.column("ids"), strict=True):
            text = ",".join(map(str, np.cumsum(np.frombuffer(zlib.decompress(packed.as_buffer()), "<i8")).tolist())).encode()
            if node_id != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = node_id, hashlib.sha256(text)
            else:
                state.update(b",")
                state.update(text)
    if node is not None:
        out.append((node, state.hexdigest()))
    yield pa.RecordBatch.from_pydict({"node_id": pa.array([x for x, _ in out], pa.binary()), "sha": pa.array([x for _, x in out], pa.string())})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by turn, null first; equal ones by the digest of role and text, so repeated rows are repeated turns. Null
    roles and texts are empty. Rows with a null conv_id belong to no conversation. The family of a negative conv_id
    follows the sign of ``%`` in SQL. Other columns are ignored; an empty table has no conversations and no nodes, not
    even a root.
    """
    pieces = stored(shards_of(stored(rebuilt(conversations), "rebuilt")).mapInArrow(trie_pieces, PIECE), "trie-pieces")
    columns = [c.split()[0] for c in NODE.split(", ")]
    interior = pieces.filter("node_id is null")
    spines = pieces.filter("node_id is not null and ids is null")
    chunks = pieces.filter("ids is not null").select("node_id", "shard", "chunk", "ids")

    ends = chunks.repartition("node_id").sortWithinPartitions("node_id", "shard", "chunk").mapInArrow(hashed_ends, "node_id binary, sha string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = stored(spines.groupBy("node_id").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_id").alias("parent_id"), *sums).join(ends, "node_id", "left"), "trie-spines")
    named = merged.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("over"))
    shared = merged.join(named, "parent_id", "left").withColumns({"parent_conv_id": F.col("over"), "ends_sha256": F.coalesce("sha", F.lit(NOBODY))})
    # a shard's nodes under a spine ask that shard's copy of the spine, so a node with many children makes no hot key
    copies = spines.select("shard", F.col("node_id").alias("parent_id")).join(named, "parent_id")
    below = interior.filter("parent_id is not null").join(copies, ["shard", "parent_id"]).withColumn("parent_conv_id", F.col("over"))
    return interior.filter("parent_id is null").select(columns).unionByName(below.select(columns)).unionByName(shared.select(columns))


#: By the definition: every prefix of every rebuilt conversation is a row; crc32 as in the shards' twin.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
), turns AS (
  SELECT conv_id, turn, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'d': digest, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, digest) AS turns
  FROM turns GROUP BY conv_id
), heads AS (
  SELECT o.*, b.turns AS head,
    (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(o.conv_id::VARCHAR)), lambda i: ascii(substr(o.conv_id::VARCHAR, i + 1, 1))::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 4)::BIGINT AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20, crc_table
), whole AS (
  SELECT conv_id, list_concat(coalesce(head, [])[1:h], turns[h + 1:]) AS turns FROM heads
), prefixes AS (
  SELECT conv_id, d AS depth, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS node,
    CASE WHEN d > 0 THEN array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), '') END AS parent,
    CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w, len(turns) = d AS ends
  FROM whole, lateral (SELECT unnest(range(len(whole.turns) + 1)) AS d)
), nodes AS (
  SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)
), below AS (
  SELECT left(node, 32 * d) AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
  FROM counted, lateral (SELECT unnest(range(counted.depth + 1)) AS d) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below USING (node) LEFT JOIN counted p ON p.node = c.parent
"""
