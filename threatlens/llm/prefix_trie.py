"""Prefix trie of conversations, built as burst tries.

Turns become 16-byte ids (SHA-256 of role and text), and a conversation a
sequence of ids, cut into segments of ``SEGMENT`` turns; a segment that is not
full ends its conversation (an empty one stands for an end at a multiple of
``SEGMENT``, or for no turns at all).  A trie head is the digest of all full
segments before a segment (running sums modulo 2**64 of their hashes by place),
so the segments of conversations of any length are placed under their heads at
once, not level by level.  Equal segments under a head become one row with the
number of its conversations and their smallest id.

The rows under a head are its container.  While a container holds more than
``CONTAINER_ROWS`` distinct suffixes it bursts: its head becomes a node, and
the suffixes go to one container for each next turn id, which takes
``SEGMENT`` rounds at most.  The other containers are spread over tasks,
sorted, and swept: neighbours' common prefixes delimit the nodes, level by
level, for all containers of a batch at a time.

A node is known by its depth and smallest member.  Sums over subtrees come in
three parts: a swept container adds up its own nodes; its totals go to the
burst heads above it; and what lies below a segment's end is the sum, over its
conversations, of the totals of the later containers whose smallest member the
conversation is, which are running sums again.

Rebuilding: conversation c is the first h turns of conversation c - c % 20
(crc32 of c's digits, modulo 4, is h), then its own turns after its first h.

Cases: turns are ordered by ``turn``, null first, equal ones by role and then
the digest of role and text; repeated rows are turns of their own.  Null role or
text is empty.  Rows with a null conv_id belong to no conversation and take no
part.  A conversation that is left without turns ends at the root.  ``c % 20``
has the sign of c.  Texts are hashed whole.  An empty table gives no rows.
Only ``conv_id``, ``turn``, ``role`` and ``text`` are read, so other columns'
names cannot clash.  No group is collected but segments and containers, which
are bounded; a node's list of ends is hashed as a stream of bounded chunks.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, staged
from .scan import running

#: Turns of a segment.
SEGMENT = 16
#: Distinct suffixes of a container that does not burst.
CONTAINER_ROWS = 512
#: Suffixes swept at a time.
SWEEP_ROWS = 8192
ID = 16
BORROW_EVERY = 20
BORROW_TURNS = 4
#: Conversations of a chunk of a node's ends: 2**12 values of conv_id.
END_BITS = 12
NODE = "depth long, conv_id long, parent long, n long, kids long, leaves long, saved long"
FACT = NODE + ", k long, gid string, path array<long>"
_NODE = [c.split()[0] for c in NODE.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), tid (id of the turn), words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tid = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, ID)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        tid.alias("tid"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("tid")]
    return running(staged(rows, "turn-ids"), "conv", order, ["one"], "turns").select(
        "conv", (F.col("before_one") + 1).alias("pos"), "tid", "words")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, len of all conversations, and conv, pos, tid, words of the turns
    of the rebuilt ones that have any."""
    convs = own.groupBy("conv").agg(F.max("pos").alias("n"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(BORROW_TURNS)).cast("long")
    plan = convs.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % BORROW_EVERY).alias("src"))
    heads = convs.where(F.col("conv") % BORROW_EVERY == 0).select(F.col("conv").alias("src"), F.col("n").alias("n_src"))
    plan = plan.join(heads, "src", "left").withColumn("m", F.least("h", F.coalesce("n_src", F.lit(0))))
    plan = staged(plan.select("conv", "src", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
                  "rebuilding")
    lent = own.where((F.col("conv") % BORROW_EVERY == 0) & (F.col("pos") < BORROW_TURNS)).withColumnRenamed("conv", "src")
    lent = lent.join(plan.where("m > 0").select("conv", "src", "m"), "src").where("pos <= m")
    kept = own.join(plan.select("conv", "h", "m"), "conv").where("pos > h")
    return plan.select("conv", "len"), lent.select("conv", "pos", "tid", "words").unionByName(
        kept.select("conv", (F.col("m") + F.col("pos") - F.col("h")).alias("pos"), "tid", "words"))


def segments(convs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """One row a segment: conv, k, ids (joined), words, w0 (words of the turn
    before), a and b (digest of the head), gid (digest of head and ids), ends
    (it is the conversation's last)."""
    p = F.col("pos")
    place = lambda k, pos, tid: F.struct(k.cast("long").alias("k"), pos.alias("p"), tid.alias("tid"), F.col("words"))
    none = F.lit(None).cast("binary")
    placed = rows.withColumn("s", F.explode(F.when(
        p % size == 0, F.array(place((p - 1) / size, p, F.col("tid")), place(p / size, F.lit(0).cast("long"), none)))
        .otherwise(F.array(place(F.floor((p - 1) / size), p, F.col("tid")))))).select("conv", "s.*")
    empty = convs.where("len = 0").select("conv", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("p"),
                                          none.alias("tid"), F.lit(0).cast("long").alias("words"))
    real = F.col("tid").isNotNull()
    cut = placed.unionByName(empty).groupBy("conv", "k").agg(
        F.array_sort(F.collect_list(F.when(real, F.struct("p", "tid", "words")))).alias("t"),
        F.max(F.when(~real, F.col("words"))).alias("w0"))
    ids = F.aggregate("t", F.lit(b""), lambda a, x: F.concat(a, x["tid"]))
    cut = cut.select("conv", "k", ids.alias("ids"), F.transform("t", lambda x: x["words"]).alias("words"),
                     F.coalesce("w0", F.lit(0)).alias("w0"))
    full = F.length("ids") == size * ID
    digest = F.sha2(F.concat(F.concat(F.col("k").cast("string"), F.lit(":")).cast("binary"), F.col("ids")), 256)
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    cut = staged(cut.select("*", lane(1).alias("da"), lane(16).alias("db"), (~full).alias("ends")), "cut")
    zero = F.lit(0).cast("long")
    short = cut.where((F.col("k") == 0) & F.col("ends")).withColumns({"a": zero, "b": zero})
    long = cut.where((F.col("k") > 0) | ~F.col("ends"))
    if not long.isEmpty():
        long = running(long, "conv", [F.col("k")], ["da", "db"], "heads").withColumnsRenamed({"before_da": "a", "before_db": "b"})
        short = short.unionByName(long)
    head = F.concat_ws(":", "k", "a", "b")
    return staged(short.select("conv", "k", "ids", "words", "w0", F.md5(head).alias("head"), F.md5(
        F.concat(head.cast("binary"), F.lit(b"|"), F.col("ids"))).alias("gid"), "ends"), "segments")


def _levels(t: dict, size: int):
    """Nodes of sorted suffixes, level by level under their containers' heads:
    first row, members, smallest member, parent's number in the level above."""
    rows = len(t["ck"])
    length = np.array([len(x) // ID for x in t["ids"]])
    path = np.frombuffer(b"".join(x.ljust(size * ID, b"\0") for x in t["ids"]), np.uint64).reshape(rows, size, ID // 8)
    same = np.zeros((rows, size), bool)
    same[1:] = (path[1:] == path[:-1]).all(axis=2)
    shorter = np.minimum(length, np.r_[0, length[:-1]])
    same &= np.arange(size) < shorter[:, None]
    common = np.cumprod(same, axis=1).sum(axis=1)
    common[np.r_[True, t["ck"][1:] != t["ck"][:-1]]] = -1
    members = np.r_[0, np.cumsum(t["n"])]
    least = np.r_[t["least"], np.iinfo(np.int64).max]
    out = []
    for level in range(int(length.max()) + 1):
        bounds = np.flatnonzero(common < level)
        start = bounds[length[bounds] >= level]
        end = np.r_[bounds, rows][np.searchsorted(bounds, start, side="right")]
        out.append({"start": start, "n": members[end] - members[start],
                    "least": np.minimum.reduceat(least, np.c_[start, end].ravel())[::2] if len(start) else start,
                    "up": np.searchsorted(out[-1]["start"], start, side="right") - 1 if out else None})
    return length, out


def _swept(t: dict, size: int) -> list[tuple]:
    """Facts of whole containers: their nodes, totals, and rows' ends or paths."""
    length, levels = _levels(t, size)
    room = size * (t["k"] + 1) - t["depth"]
    width = len(levels)
    words = np.zeros((len(length), width), np.int64)
    for i, w in enumerate(t["words"]):
        words[i, 1:1 + len(w)] = w
    words[:, 0] = t["w0"]
    for level in range(width - 1, -1, -1):
        x = levels[level]
        count = len(x["start"])
        x["edge"] = room[x["start"]] == level  # continued in the next segment's container
        x["kids"] = np.zeros(count, np.int64)
        x["leaves"], x["saved"] = np.zeros(count, np.int64), (x["n"] - 1) * words[x["start"], level]
        x["saved"][x["edge"]] = 0
        if level + 1 < width:
            below = levels[level + 1]
            for k, v in (("kids", 1), ("leaves", below["leaves"]), ("saved", below["saved"])):
                np.add.at(x[k], below["up"], v)
        x["leaves"] += (x["kids"] == 0) & ~x["edge"]
    facts = []
    for level, x in enumerate(levels):
        depth = (t["depth"][x["start"]] + level).tolist()
        if level:
            parent = levels[level - 1]["least"][x["up"]].tolist()
        else:
            parent = [t["parent"][i] for i in x["start"].tolist()]
        cells = zip(depth, x["least"].tolist(), parent, x["edge"].tolist(), *(x[c].tolist() for c in ("n", "kids", "leaves", "saved")))
        facts += [(d, c, p, 0, 0, 0, 0, None, None, None) if e else (d, c, p, *v, None, None, None) for d, c, p, e, *v in cells]
    top = levels[0]
    for i, own, leaves, saved in zip(top["start"].tolist(), *(top[c].tolist() for c in ("least", "leaves", "saved"))):
        above, depth = t["up"][i], int(t["depth"][i])
        if leaves or saved:
            facts += [(depth - len(above) + j, o, None, 0, 0, leaves, saved, None, None, None) for j, o in enumerate(above)]
            if t["k"][i]:
                facts.append((None, own, None, 0, 0, leaves, saved, int(t["k"][i]), None, None))
    at = [np.searchsorted(x["start"], np.arange(len(length)), side="right") - 1 for x in levels]
    for i, n in enumerate(length.tolist()):
        if n == room[i]:
            path = [*t["up"][i], *(int(levels[j]["least"][at[j][i]]) for j in range(n))]
            facts.append((int(t["depth"][i]) + n - size, None, None, 0, 0, 0, 0, None, t["gid"][i], path))
        else:
            facts.append((int(t["depth"][i]) + n, int(levels[n]["least"][at[n][i]]), None, 0, 0, 0, 0, None, t["gid"][i], None))
    return facts


_FACT_TYPE = pa.schema([*((c, pa.int64()) for c in _NODE), ("k", pa.int64()), ("gid", pa.string()),
                        ("path", pa.list_(pa.int64()))])


def _sweeper(size: int, at_once: int):
    """Sweep of a partition sorted by container and suffix, whole containers at
    a time; the last container waits for the next batch."""
    def emit(table):
        columns = {c: table.column(c) for c in table.column_names}
        t = {c: np.array(v.to_pylist() if c == "ck" else v.to_numpy()) for c, v in columns.items()
             if c in ("ck", "depth", "k", "w0", "n", "least")}
        t |= {c: v.to_pylist() for c, v in columns.items() if c not in t}
        facts = _swept(t, size)
        arrays = [pa.array(x, f.type) for x, f in zip(zip(*facts), _FACT_TYPE)]
        yield from pa.Table.from_arrays(arrays, schema=_FACT_TYPE).to_batches(max_chunksize=10_000)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if len(held) >= at_once:
                ck = np.array(held.column("ck").to_pylist())
                change = np.flatnonzero(ck[1:] != ck[:-1])
                if len(change):
                    cut = int(change[-1]) + 1
                    yield from emit(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None:
            yield from emit(held)

    return run


def _grown(segs: DataFrame, size: int, limit: int) -> DataFrame:
    """Facts of all containers: burst while over ``limit``, then swept."""
    groups = segs.groupBy("gid").agg(F.count("*").alias("n"), F.min("conv").alias("least"),
                                     *[F.any_value(c).alias(c) for c in ("k", "head", "ids", "words", "w0")])
    none = F.lit(None).cast("long")
    work = staged(groups.select(
        F.col("head").alias("ck"), (F.col("k") * size).alias("depth"), "k", none.alias("parent"),
        F.array().cast("array<long>").alias("up"), "w0", "ids", "words", "n", "least", "gid"), "containers")
    calm, facts = [], []
    nothing = F.lit(0).cast("long")
    row = lambda depth, conv, parent=none, n=nothing, kids=nothing, saved=nothing, k=none, gid=F.lit(None).cast("string"): [
        x.alias(c) for x, c in zip((depth, conv, parent, n, kids, nothing, saved, k, gid, F.lit(None).cast("array<long>")),
                                   _FACT_TYPE.names)]
    while True:
        following = F.when(F.length("ids") > 0, F.substring("ids", 1, ID))
        over = staged(work.groupBy("ck").agg(
            F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("least").alias("owner"),
            F.count_distinct(following).alias("kids"), *[F.any_value(c).alias(c) for c in ("depth", "k", "up", "w0")],
            F.max("parent").alias("parent")).where(F.col("rows") > limit), "burst")
        if over.isEmpty():
            calm.append(work)
            break
        calm.append(work.join(over, "ck", "left_anti"))
        saved = (F.col("n") - 1) * F.col("w0")
        facts.append(over.select(*row(F.col("depth"), F.col("owner"), F.col("parent"), F.col("n"), F.col("kids"), saved)))
        above = over.withColumn("s", saved).select("depth", "up", "s", F.posexplode("up").alias("at", "o"))
        facts.append(above.select(*row(F.col("depth") - F.size("up") + F.col("at"), F.col("o"), saved=F.col("s"))))
        facts.append(over.where("k > 0").select(*row(none, F.col("owner"), saved=saved, k=F.col("k"))))
        hot = work.join(over.select("ck", "owner"), "ck")
        ended = F.length("ids") == 0
        facts.append(hot.where(ended).select(*row(F.col("depth"), F.col("owner"), gid=F.col("gid"))))
        work = staged(hot.where(~ended).select(
            F.md5(F.concat(F.col("ck").cast("binary"), following)).alias("ck"), (F.col("depth") + 1).alias("depth"), "k",
            F.col("owner").alias("parent"), F.concat("up", F.array("owner")).alias("up"), F.get("words", F.lit(0)).alias("w0"),
            F.expr(f"substring(ids, {ID + 1})").alias("ids"), F.expr("slice(words, 2, size(words))").alias("words"),
            "n", "least", "gid"), "containers")
    ordered = reduce(DataFrame.unionByName, calm).repartition(parallelism(segs.sparkSession), "ck").sortWithinPartitions("ck", "ids")
    facts.append(ordered.mapInArrow(_sweeper(size, SWEEP_ROWS), FACT))
    return staged(reduce(DataFrame.unionByName, facts), "facts")


def _below(facts: DataFrame, segs: DataFrame) -> DataFrame | None:
    """What lies below the ends of full segments, for the nodes on their paths."""
    long = segs.where((F.col("k") > 0) | ~F.col("ends")).select("conv", "k", "gid", "ends")
    if long.isEmpty():
        return None
    totals = facts.where("k is not null").groupBy(F.col("conv_id").alias("conv"), "k").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    own = long.join(totals, ["conv", "k"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("leaves", "saved")})
    later = running(staged(own, "totals"), "conv", [F.desc("k")], ["leaves", "saved"], "later").where(~F.col("ends"))
    later = later.groupBy("gid").agg(F.sum("before_leaves").alias("leaves"), F.sum("before_saved").alias("saved"))
    paths = facts.where("path is not null").select("gid", "depth", F.posexplode("path").alias("at", "conv_id"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    return paths.join(later, "gid").select((F.col("depth") + F.col("at")).alias("depth"), "conv_id", none.alias("parent"),
                                           zero.alias("n"), zero.alias("kids"), "leaves", "saved")


def _end_digests(batches):
    """depth, conv_id, SHA-256 of a node's chunks, which come in order."""
    at, digest, out = None, None, []
    for batch in batches:
        for depth, conv, chunk in zip(*(batch.column(c).to_pylist() for c in ("depth", "conv_id", "chunk"))):
            if at == (depth, conv):
                digest.update(b",")
            else:
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (depth, conv), hashlib.sha256()
            digest.update(chunk.encode())
        if len(out) >= 4096:
            yield _digest_batch(out)
            out = []
    if at is not None:
        yield _digest_batch([*out, (*at, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    depth, conv, sha = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(conv, pa.int64()), pa.array(sha)],
                                      ["depth", "conv_id", "ends_sha256"])


def build(conversations: DataFrame, size: int = SEGMENT, limit: int = CONTAINER_ROWS) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, rows = rebuilt(turns(conversations))
    segs = segments(convs, rows, size)
    facts = _grown(segs, size, limit)
    parts = facts.where("k is null and gid is null").select(*_NODE)
    below = _below(facts, segs)
    nodes = (parts if below is None else parts.unionByName(below)).groupBy("depth", "conv_id").agg(
        F.max("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    stops = facts.where("gid is not null and path is null").select("gid", "depth", "conv_id")
    chunks = (segs.where("ends").select("conv", "gid").join(stops, "gid")
              .groupBy("depth", "conv_id", F.shiftright("conv", END_BITS).alias("bucket"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("chunk")))
    ends = (chunks.repartition(parallelism(segs.sparkSession), "depth", "conv_id")
            .sortWithinPartitions("depth", "conv_id", "bucket").select("depth", "conv_id", "chunk")
            .mapInArrow(_end_digests, "depth long, conv_id long, ends_sha256 string"))
    return nodes.join(ends, ["depth", "conv_id"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
