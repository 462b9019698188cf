"""Prefix trie of conversations by hashes of fixed-length blocks of turns.

A node is a distinct sequence of first turns (role, text). Turns are reduced
to a digest; the digest of a prefix is the exclusive or of its turns' hashes
by place, 128 bits, so the running digests of a conversation of any length
come from one distributed scan. Conversations are cut into blocks of
``BLOCK`` turns. First they are grouped by whole blocks (entry digest and
turns of the block): one row for each distinct block, with its number of
conversations. Only where a block has siblings with the same entry are its
turn boundaries refined, that is, the turns of the distinct blocks grouped
one by one; a block without siblings is a chain.

Sums over subtrees go along paths: a node belongs to its smallest member, the
nodes of one member form a path from where it leaves the path of a smaller
one down to its last turn. Totals of whole paths are added up by pointer
jumping over the tree of paths, those within a path by a scan.

* Turns are ordered by ``turn`` (null first), equal ones by the SHA-256 of
  role and text. Null roles and texts are empty. Repeated rows are turns of
  their own. Rows without a conversation id are left out.
* A conversation of a third of all turns, a first turn that a third of all
  conversations share and equal conversations are spread over tasks; the list
  of ids that end at one node is hashed as a stream of long pieces.
* No conversations: no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.runs import looked_up, running, sorted_by
from tessera.session import ship_package

#: Turns a block.
BLOCK = 4
#: Turns of another conversation that may precede a rebuilt one.
HEAD = 8
_NONE = hashlib.sha256(b"").hexdigest()


def _digest(role: Column, text: Column) -> Column:
    """First half of the SHA-256 of role and text, told apart by the role's length."""
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(framed.cast("binary"), 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (1, 2, ...), ``digest``, ``n_bytes`` (of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("one"),
        F.monotonically_increasing_id().alias("_u"))  # only lets repeated rows lie in several tasks
    order = ["conv_id", "turn", "digest", "_u"]
    done = running(sorted_by(turns, order, order), "conv_id", {"one": "sum"}, "turns")
    return done.select("conv_id", F.col("one_upto").alias("pos"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of conversation
    c - c % 5 (h = CRC-32 of the decimal c, modulo 9) and go on with their own
    turns after the first h. Returns turns with the length ``n`` of their
    conversation, and the conversations (``conv_id``, ``n``, 0 if turnless)."""
    own = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("own")), "lengths")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    convs = own.select("conv_id", "own", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    first = own.select(F.col("conv_id").alias("base"), F.col("own").alias("_base_own"))
    taken = F.least("h", F.coalesce("_base_own", F.lit(0)))
    convs = materialize(convs.join(first, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "rebuilt")
    begins = turns.where((F.col("pos") <= HEAD) & (F.col("conv_id") % 5 == 0)).withColumnRenamed("conv_id", "base")
    heads = begins.join(convs, "base").where("pos <= h").select("conv_id", "pos", "n", "digest", "n_bytes")
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    tails = looked_up(turns.where(F.col("pos") > own_head), convs.select("conv_id", "h", "taken", "n"), ["conv_id"]).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "n", "digest", "n_bytes")
    return heads.unionByName(tails), convs.select("conv_id", "n")


def _to_blocks(batches):
    """Sorted turns to one row a block: running digests ``a``, ``b`` from the
    block's entry, bytes ``w``, whole digests ``xa``, ``xb``."""
    held = None

    def made(t: pa.Table):
        conv, blk = t["conv_id"].to_numpy(), t["blk"].to_numpy()
        starts = np.r_[0, np.flatnonzero((conv[1:] != conv[:-1]) | (blk[1:] != blk[:-1])) + 1]
        ends = np.r_[starts[1:], len(conv)]
        cols, whole = [], []
        for c in ("la", "lb"):
            acc = np.bitwise_xor.accumulate(t[c].to_numpy())
            acc = acc ^ np.repeat(np.r_[0, acc[starts[1:] - 1]], ends - starts)
            cols.append(acc)
            whole.append(pa.array(acc[ends - 1]))
        off = pa.array(np.r_[starts, len(conv)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(off, pa.array(c)) for c in (*cols, t["n_bytes"].to_numpy())]
        last = t["pos"].to_numpy()[ends - 1] == t["n"].to_numpy()[ends - 1]
        return pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(blk[starts]), *lists, *whole, pa.array(last.astype(np.int64))],
                                          ["conv_id", "blk", "a", "b", "w", "xa", "xb", "last"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        conv, blk = t["conv_id"].to_numpy(), t["blk"].to_numpy()
        cut = int(np.flatnonzero((conv == conv[-1]) & (blk == blk[-1]))[0])
        held = t.slice(cut)  # the last block may go on: at most BLOCK rows
        if cut:
            yield made(t.slice(0, cut))
    if held is not None:
        yield made(held)


def _blocks(turns: DataFrame) -> DataFrame:
    """One row for each conversation and block, with the digests ``ea``, ``eb`` of the prefix in front of it."""
    place = F.xxhash64("digest", "pos"), F.xxhash64(F.lit(1), "digest", "pos")
    rows = turns.select("conv_id", F.expr(f"(pos - 1) div {BLOCK}").alias("blk"), "pos", "n", place[0].alias("la"), place[1].alias("lb"), "n_bytes")
    schema = "conv_id long, blk long, a array<long>, b array<long>, w array<long>, xa long, xb long, last long"
    made = sorted_by(rows, ["conv_id", "blk"], ["conv_id", "pos"]).mapInArrow(_to_blocks, schema)
    done = running(made, "conv_id", {"xa": "xor", "xb": "xor"}, "blocks")
    return done.select("conv_id", "blk", "a", "b", "w", "last", "xa_upto", "xb_upto",
                       F.col("xa_upto").bitwiseXOR(F.col("xa")).alias("ea"), F.col("xb_upto").bitwiseXOR(F.col("xb")).alias("eb"))


def _turns_of(edges: DataFrame) -> DataFrame:
    """The turns of distinct blocks: node and parent digests by depth."""
    each = edges.select("*", F.posexplode(F.arrays_zip("a", "b", "w")).alias("j", "t"), F.size("a").alias("_len"))
    j, at_end = F.col("j"), F.col("j") == F.col("_len") - 1
    def inside(c: str) -> Column:
        return F.when(j > 0, F.get(F.col(c), j - 1)).otherwise(F.lit(0).cast("long"))
    return each.select(
        (F.col("blk") * BLOCK + j + 1).alias("depth"),
        F.col("ea").bitwiseXOR(F.col("t.a")).alias("na"), F.col("eb").bitwiseXOR(F.col("t.b")).alias("nb"),
        F.col("ea").bitwiseXOR(inside("a")).alias("pa"), F.col("eb").bitwiseXOR(inside("b")).alias("pb"),
        F.col("t.w").alias("w"), "n_convs", "conv_id", F.when(at_end, F.col("n_ends")).otherwise(F.lit(0)).alias("n_ends"),
        F.when(at_end, F.col("end_conv")).alias("end_conv"))


def _nodes(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes: ``depth``, digests ``na``, ``nb`` and ``pa``, ``pb`` of the
    parent, bytes ``w`` of the last text, ``n_convs``, owner ``conv_id``,
    number ``n_ends`` and smallest ``end_conv`` of the members that end here."""
    edges = materialize(blocks.groupBy("blk", "ea", "eb", "a", "b", "w").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("last").alias("n_ends"),
        F.min(F.when(F.col("last") == 1, F.col("conv_id"))).alias("end_conv")), "edges")
    entry = ["blk", "ea", "eb"]
    diverging = edges.groupBy(*entry).agg(F.count(F.lit(1)).alias("_s")).where("_s > 1").select(*entry, F.lit(True).alias("_many"))
    marked = materialize(looked_up(edges, diverging, entry), "marked")
    chains = _turns_of(marked.where("_many is null").drop("_many"))
    refined = _turns_of(marked.where("_many").drop("_many")).groupBy("depth", "na", "nb").agg(
        F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("w").alias("w"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends"), F.min("end_conv").alias("end_conv"))
    zero, empty = F.lit(0).cast("long"), F.when(F.col("n") == 0, F.col("conv_id"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count(empty).alias("n_ends"),
                     F.min(empty).alias("end_conv")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in ("depth", "na", "nb", "pa", "pb", "w")], "n_convs", "conv_id", "n_ends", "end_conv")
    return materialize(chains.unionByName(refined).unionByName(root), "nodes")


def _paths(nodes: DataFrame) -> DataFrame:
    """One row for each owner: its path's depths ``top`` and ``len``, the
    deepest ``shared`` one (null if none), ``parent`` (owner of the node above
    the path, null for the root's) and own sums ``leaves``, ``saved``."""
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    tops = materialize(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max("depth").alias("len"), F.max(F.when(shared, F.col("depth"))).alias("shared"),
        F.min_by("pa", "depth").alias("na"), F.min_by("pb", "depth").alias("nb"),
        F.sum((F.col("n_convs") - 1) * F.col("w")).alias("saved")), "paths")
    above = tops.where("top > 0").withColumn("depth", F.col("top") - 1)
    owners = nodes.where(shared).select("depth", "na", "nb", F.col("conv_id").alias("parent"))
    up = looked_up(above, owners, ["depth", "na", "nb"]).select("conv_id", "top", "len", "shared", "saved", "parent")
    root = tops.where("top = 0").select("conv_id", "top", "len", "shared", "saved", F.lit(None).cast("long").alias("parent"))
    up = materialize(up.unionByName(root), "parents")
    # a path's last node is a leaf unless another path begins below it
    below = up.where("parent is not null").select(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("len"), F.lit(0).alias("_leaf")).distinct()
    return up.join(below, ["conv_id", "len"], "left").withColumn("leaves", F.coalesce("_leaf", F.lit(1)).cast("long")).drop("_leaf")


def _subtrees(paths: DataFrame) -> DataFrame:
    """``conv_id``, ``leaves``, ``saved``: sums over each path and all paths
    that begin below it. In every round a path adds its sums to the ancestor
    it points to and points twice as far."""
    state = materialize(paths.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "sums")
    while not state.where("up is not null").isEmpty():
        moving = state.where("up is not null")
        more = moving.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        further = looked_up(moving.select("conv_id", "up"), state.select(F.col("conv_id").alias("up"), F.col("up").alias("_next")), ["up"])
        state = materialize(
            state.drop("up").join(further.select("conv_id", F.col("_next").alias("up")), "conv_id", "left").join(more, "conv_id", "left").select(
                "conv_id", "up", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")), "sums")
    return state.select("conv_id", "leaves", "saved")


def _pieces(batches):
    """Sorted (conv_id, depth, member) to texts of consecutive members, one a node and batch."""
    for b in batches:
        if not b.num_rows:
            continue
        conv, depth, member = (b.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
        starts = np.r_[0, np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1]
        ends = np.r_[starts[1:], len(conv)]
        text = [",".join(map(str, member[s:e].tolist())) for s, e in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array(text)],
                                         ["conv_id", "depth", "member", "ids"])


def _hashed(batches):
    """Pieces in order to one SHA-256 a node; only one piece is held at a time."""
    at, state = None, None
    for b in batches:
        done = []
        for conv, depth, ids in zip(*(b.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if (conv, depth) != at:
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (conv, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(done)
    if at is not None:
        yield _rows([(*at, state.hexdigest())])


def _rows(done):
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                                       pa.array([d[2] for d in done], pa.string())], ["conv_id", "depth", "ends_sha256"])


def _end_hashes(nodes: DataFrame, blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``ends_sha256`` of the nodes at which several conversations end."""
    key = ["depth", "na", "nb"]
    several = nodes.where("n_ends > 1").select(*key, F.col("conv_id").alias("owner"))
    zero = F.lit(0).cast("long")
    ends = blocks.where("last = 1").select(
        F.col("conv_id").alias("member"), (F.col("blk") * BLOCK + F.size("a")).alias("depth"), F.col("xa_upto").alias("na"), F.col("xb_upto").alias("nb"))
    ends = ends.unionByName(convs.where("n = 0").select(F.col("conv_id").alias("member"), *[zero.alias(c) for c in key]))
    found = looked_up(ends, several, key, "inner").select(F.col("owner").alias("conv_id"), "depth", "member")
    order = ["conv_id", "depth", "member"]
    pieces = sorted_by(found, order, order).mapInArrow(_pieces, "conv_id long, depth long, member long, ids string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions(*order).mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie over ``turns`` (``conv_id``, ``pos`` from 1 without
    gaps, ``n`` turns of the conversation, ``digest``, ``n_bytes``) of
    ``convs`` (``conv_id``, ``n``, which may be 0)."""
    blocks = _blocks(turns)
    nodes = _nodes(blocks, convs)
    paths = materialize(_paths(nodes), "owners")
    sums = _subtrees(paths)
    at = ["conv_id", "depth"]
    begun = paths.where("parent is not null").select("conv_id", F.col("parent"), (F.col("top") - 1).alias("_at")).join(sums, "conv_id")
    hung = begun.groupBy(F.col("parent").alias("conv_id"), F.col("_at").alias("depth")).agg(
        F.count(F.lit(1)).alias("_below"), F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    tops = paths.select("conv_id", F.col("top").alias("depth"), "parent", F.lit(True).alias("_top"))
    deepest = paths.where("shared is not null").select("conv_id", F.col("shared").alias("depth"), "len", "leaves")
    hashes = _end_hashes(nodes, blocks, convs)
    zero = F.lit(0).cast("long")
    ends = (F.when(F.col("n_ends") == 0, F.lit(_NONE)).when(F.col("n_ends") == 1, F.sha2(F.col("end_conv").cast("string").cast("binary"), 256))
            .otherwise(F.col("ends_sha256")))
    full = nodes.join(tops, at, "left").join(hung, at, "left").join(deepest, at, "left").join(hashes, at, "left").select(
        "conv_id", "depth", F.when(F.col("_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", "n_ends",
        # on a path, every shared node but the deepest goes on; the deepest does if the path is longer
        (F.coalesce("_below", zero) + F.when(F.col("len").isNull() | (F.col("len") > F.col("depth")), 1).otherwise(0)).alias("n_children"),
        (F.coalesce("_leaves", zero) + F.coalesce("leaves", zero)).alias("_l"),
        (F.coalesce("_saved", zero) + (F.col("n_convs") - 1) * F.col("w")).alias("_s"), ends.alias("ends_sha256"), (-F.col("depth")).alias("_up"))
    full = materialize(full, "trie")
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    order = ["conv_id", "_up"]
    inner = running(sorted_by(full.where(shared), order, order), "conv_id", {"_l": "sum", "_s": "sum"}, "subtrees").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("_l_upto").alias("n_leaves"), F.col("_s_upto").alias("saved_tokens"), "ends_sha256")
    alone = full.where(~shared).select(  # the tail of one conversation
        "conv_id", "depth", "parent_conv_id", "n_convs", (1 - F.col("n_ends")).alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256")
    return inner.unionByName(alone)


def with_texts(nodes: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with ``role`` and ``text`` of their last turn (null for the
    root); ``turns`` are those that the trie was built from."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    texts = conversations.where("conv_id is not null").select(role.alias("role"), text.alias("text"), _digest(role, text).alias("digest"))
    last = turns.select("conv_id", F.col("pos").alias("depth"), "digest")
    return looked_up(nodes.join(last, ["conv_id", "depth"], "left"), texts.dropDuplicates(["digest"]), ["digest"]).drop("digest")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie over all rebuilt ``conversations``."""
    ship_package(spark)
    turns, convs = rebuilt(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(turns, convs)
