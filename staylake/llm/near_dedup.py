"""MinHash near-duplicates by a multi-index Hamming join."""

from __future__ import annotations

from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stored, texts
from .words import forget, hashes, list_parts, lists, mix, slices, windows

CHUNKS, WIDTH, ERRORS = 6, 6, 2  # a signature has CHUNKS * WIDTH values; so many values of one chunk may differ
VALUES = CHUNKS * WIDTH
REACH = CHUNKS * (ERRORS + 1) - 1  # pairs whose signatures differ in at most so many values all meet (pigeonhole)
PARITY = 8  # longs of a set's parity sketch
GAIN = 20  # classes go on meeting pivots while one meeting in so many is a link; the rest is compared by rare differences

_RNG = np.random.default_rng(20240)
_XOR, _MUL = (_RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(2))


def shingles(words: list[bytes], size: int = 2) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``size`` words; fewer words are one shingle of their own kind."""
    h = hashes(words)
    if len(h) >= size:
        return np.unique(windows(h, size))
    return mix(windows(h, max(len(h), 1)), np.full(min(len(h), 1), len(h), np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each of the smallest values of ``VALUES`` hash orders."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        low = np.minimum(low, ((s[None, a : a + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (low ^ (low >> np.uint64(32))).astype(np.uint64) * _MUL >> np.uint64(48)


def _cut(text: str, size: int) -> np.ndarray:
    return shingles(text.encode().lower().split(), size)


def _describe(size: int):
    def run(batches):
        forget()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [_cut(t, size) for t in batch["text"].to_pylist()]
                yield pa.record_batch(
                    [
                        batch["doc_id"], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        lists([signature(s).astype(np.int32) if len(s) else np.zeros(0, np.int32) for s in sets], np.int32),
                    ],
                    ["doc_id", "n_shingles", "print", "sig"],
                )

    return run


def parity(s: np.ndarray) -> np.ndarray:
    """One bit per bucket of hashes: whether it holds an odd number of members.

    Two sketches differ in at most as many bits as the sets have members of their own.
    """
    odd = np.bincount((s >> np.uint64(64 - (PARITY * 64 - 1).bit_length())).astype(np.int64), minlength=PARITY * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _spell(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [_cut(t, size) for t in batch["text"].to_pylist()]
                columns = [pa.array([len(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets], np.int64), lists([parity(s) for s in sets], np.int64)]
                yield pa.record_batch([batch["doc_id"], *columns], ["node", "n", "s", "odd"])

    return run


def _sides(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of both nodes, suffixed."""
    for c in ("a", "b"):
        pairs = pairs.join(own.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in own.columns if x != "node")), c)
    return pairs


def _reach(both: Column | str, percent: int) -> Column:
    """Whether sets of n_a and n_b members, of which ``both`` are in both, reach the similarity."""
    return F.expr(f"100 * ({both}) >= {percent} * (n_a + n_b - ({both}))")


def confirm(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), the pairs whose full sets in ``own`` (node, n, s) reach the similarity."""
    met = _sides(pairs.select("a", "b"), own.select("node", "n", "s")).filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return stored(met.filter(_reach("size(array_intersect(s_a, s_b))", percent)).select("a", "b").distinct())


def _moved(labels: DataFrame | None, step: DataFrame) -> DataFrame:
    """Labels (node, root) after the roots themselves got roots in ``step``."""
    if labels is None:
        return step
    up = step.select(F.col("node").alias("_r"), F.col("root").alias("_to"))
    old = labels.join(up, F.col("root") == F.col("_r"), "left").select("node", F.coalesce("_to", "root").alias("root"))
    return stored(old.unionByName(step.join(labels.select("node"), "node", "left_anti")))


def _rooted(parent: DataFrame) -> DataFrame:
    """Parents (node, root), each smaller than its node, followed to the top by pointer jumping."""
    while True:
        up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        nearer = stored(parent.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")))
        parent = nearer.select("node", "root")
        if nearer.filter("_moved").isEmpty():
            return parent


def _through(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between roots, without loops and copies."""
    for c in ("a", "b"):
        up = labels.select(F.col("node").alias("_n"), F.col("root").alias("_up"))
        edges = edges.join(up, F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce("_up", c)).select("a", "b")
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """Extend labels (node, root: the smallest node reachable) by edges. Nodes that are their own root have no row.

    Every node hooks to its smallest neighbour, trees are flattened by pointer jumping, and edges go on between roots
    until none is left: the rounds grow with the logarithm of the longest chain. Everything stays in tables.
    """
    edges = stored(_through(edges, labels) if labels is not None else edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        step = _rooted(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        labels = _moved(labels, step)
        edges = stored(_through(edges, step))
    return labels


def _packed(batches):
    chosen = np.array([c for k in range(CHUNKS) for c in combinations(range(k * WIDTH, (k + 1) * WIDTH), WIDTH - ERRORS)])
    for batch in batches:
        sig = np.array(list_parts(batch["sig"])).reshape(-1, VALUES).astype(np.int64)
        packed = np.zeros((len(sig), len(chosen)), np.int64)
        for i in range(chosen.shape[1]):
            packed = (packed << 16) | sig[:, chosen[:, i]]
        yield pa.record_batch([batch["node"], lists(list(packed), np.int64)], ["node", "keys"])


def _keys(nodes: DataFrame) -> DataFrame:
    """(slot, key, node): for each chunk and each choice of values that agree, the values packed into one number."""
    keys = nodes.select("node", "sig").mapInArrow(_packed, "node long, keys array<long>")
    return keys.select("node", F.posexplode("keys").alias("slot", "key")).select("slot", "key", "node")


def _groups(mates: DataFrame) -> DataFrame:
    """(node, g): the component of each class over shared keys. Linked classes that share a key are of one group."""
    low = mates.groupBy("slot", "key").agg(F.min("node").alias("a"))
    edges = stored(mates.join(low, ["slot", "key"]).select("a", F.col("node").alias("b")).distinct())
    labels = components(edges.filter("a <> b"))
    nodes = edges.select(F.col("b").alias("node")).distinct()
    grouped = stored(nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("g")))
    discard(edges)
    return grouped


def differences(own: DataFrame, percent: int) -> DataFrame:
    """Sets (node, g, root, n, s, odd) as differences from what most sets of their group hold.

    Returns node, g, root, n, odd, d (the size of the difference: members that most do not have, and members of most that
    are missing), e (those that another set of the group shares: held ones, then missing ones, each rarest first) and a = (100 + percent) d - (100 - percent) n.
    Two sets differ in exactly the members in which their differences differ.
    """
    own = own.withColumn("print", F.xxhash64("s"))  # an id may repeat with other texts
    sizes = own.groupBy("g").agg(F.count(F.lit(1)).alias("members"))
    common = own.select("g", F.explode("s").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = stored(common.join(sizes, "g"))
    ranked = F.array_sort(F.collect_list(F.struct("w", "x")))
    # every one of ``most`` is in over half of the sets, so it is at most twice as long as a mean set
    most = common.filter("2 * df > members").withColumn("w", F.col("members") - F.col("df")).groupBy("g").agg(ranked.alias("most"))
    # what only one set misses is in no other difference
    most = stored(most.select("g", F.expr("most.x as most"), F.expr("filter(most, m -> m.w > 1).x as missed")))
    rare = common.filter("2 * df <= members").select("g", "x", F.col("df").alias("w"))
    held = own.select("node", "print", "g", F.explode("s").alias("x")).join(rare, ["g", "x"]).groupBy("node", "print").agg(ranked.alias("held"))
    held = stored(held.select("node", "print", F.expr("held.x as held")))
    none = F.expr("cast(array() as array<bigint>)")
    full = own.join(most, "g", "left").join(held, ["node", "print"], "left")
    full = full.select("node", "g", "root", "n", "s", "odd", *(F.coalesce(c, none).alias(c) for c in ("most", "missed", "held")))
    full = full.withColumn("d", F.expr("n - size(most) + 2 * size(array_except(most, s))"))
    a = (100 + percent) * F.col("d") - (100 - percent) * F.col("n")
    out = stored(full.select("node", "g", "root", "n", "odd", "d", F.expr("concat(held, array_except(missed, s))").alias("e"), a.alias("a")))
    discard(common, most, held)
    return out


def _last_links(own: DataFrame, percent: int) -> DataFrame:
    """All links between classes of different roots in one group, as edges that give the same components."""
    delta = differences(own, percent)
    # a class near the middle links to every class whose difference is small enough, whatever the two differences hold
    middle = delta.groupBy("g").agg(F.min(F.struct("a", "node", "root")).alias("m"))
    close = delta.join(middle, "g").filter("a + m.a <= 0 and root <> m.root").select(F.col("m.node").alias("a"), F.col("node").alias("b"))
    # all others share a member of their differences, and so one of the rarest of each
    probe = F.expr(f"cast(floor({100 - percent} * n / {100 + percent}) as int) + 1 - (d - size(e))")
    reach = F.expr(f"cast(floor({100 - percent} * n / {percent}) as int) + 1 - (d - size(e))")
    head = delta.withColumn("probe", probe).withColumn("reach", reach).filter("reach > 0")
    head = head.select("g", "node", "root", "n", "a", "odd", "probe", F.size("e").alias("es"), F.posexplode(F.expr("slice(e, 1, reach)")).alias("at", "x"))
    head = stored(head.withColumn("asks", F.expr("at < probe")).withColumn("more", F.expr("es - at")).drop("probe", "es", "at"))
    cells = head.groupBy("g", "x").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("asks").alias("asked")).filter("low < high and asked")
    head_ = stored(head.join(cells.select("g", "x"), ["g", "x"], "left_semi"))
    left, right = (head_.select("g", "x", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "a", "odd", "asks", "more"))) for k in ("a", "b"))
    # exact bounds: sizes, members left from the first shared one on, bits in which the sketches differ
    bits = " + ".join(f"bit_count(odd_a[{i}] ^ odd_b[{i}])" for i in range(PARITY))
    pairs = left.filter("asks_a").join(right, ["g", "x"]).filter(
        f"root_a <> root_b and (a_a < a_b or (a_a = a_b and node_a < node_b)) and 100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" and a_a + a_b <= {2 * (100 + percent)} * least(more_a, more_b) and {100 + percent} * ({bits}) <= {100 - percent} * (n_a + n_b)"
    )
    pairs = stored(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct())
    met = _sides(pairs, delta.select("node", "n", "d", "e"))
    links = met.filter(f"{100 + percent} * (d_a + d_b - 2 * size(array_intersect(e_a, e_b))) <= {100 - percent} * (n_a + n_b)")
    out = stored(links.select("a", "b").unionByName(close).distinct())
    discard(delta, head, head_, pairs)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, size: int = 2) -> DataFrame:
    """Link documents whose sets of shingles of ``size`` words have Jaccard similarity ``percent`` / 100 or more.

    Returns per row: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Equal sets form one class first, so exact copies never meet in pairs. A class has a MinHash signature of ``VALUES``
    16-bit values. It is split into chunks; by pigeonhole, signatures that differ in at most ``REACH`` values have a
    chunk with at most ``ERRORS`` differences, so each chunk is indexed once for every choice of values that agree and
    all such pairs share a key. At the threshold a pair differs in more values with probability below 1e-4, and still
    meets in all but one case of a million.

    The classes of a key are not paired. Each class first meets one pivot, the smallest class of a key, of its keys the
    one it shares most keys with; pairs confirmed on the full sets are joined into components, and what still shares
    keys with other components meets other pivots as long as that finds links. Then the rest is settled exactly: sets
    are written as differences from what most sets of their group (classes connected over keys) hold. Linked sets have
    differences that are both small, which is seen from their sizes, or share one of their rarest members (prefix
    filter) and have parity sketches that differ in few bits; only those are compared. Components are found in tables, in a number of rounds that grows with the
    logarithm of the longest chain.

    Null and empty texts and texts without words have an empty set and are linked with nothing. A text of fewer words
    than ``size`` is one shingle. Rows that repeat a doc_id count as one node; each is returned with its own n_shingles, and kept. Rows
    with a null doc_id stand alone (component_id null, kept). An empty table gives an empty result. Other columns are not
    looked at.
    """
    docs = texts(docs, id_col, text_col)
    sets = stored(docs.mapInArrow(_describe(size), "doc_id long, n_shingles long, print binary, sig array<int>"))
    some = sets.filter("print is not null and doc_id is not null")
    classes = stored(some.groupBy("print").agg(F.min("doc_id").alias("node")))
    nodes = some.join(classes.withColumnRenamed("node", "doc_id"), ["print", "doc_id"]).select(F.col("doc_id").alias("node"), "sig").distinct()
    # an id that repeats with other texts is one node: it links the classes of its texts
    torn = some.groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low < high")
    torn = stored(some.join(torn.select("doc_id"), "doc_id", "left_semi").join(classes, "print").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct())
    keys = stored(_keys(nodes))
    shared = keys.groupBy("slot", "key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    mates = stored(keys.join(shared.select("slot", "key"), ["slot", "key"], "left_semi"))
    discard(keys)
    asked = mates.select(F.col("node").alias("doc_id")).distinct()
    own = stored(docs.join(asked, "doc_id", "left_semi").mapInArrow(_spell(size), "node long, n long, s array<long>, odd array<long>"))
    rooted, labels, step = mates.withColumn("root", F.col("node")), None, 0
    while True:
        order = F.struct((F.col("node") if step == 0 else F.xxhash64("node", F.lit(step))).alias("h"), "node", "root")
        pivots = rooted.groupBy("slot", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(order).alias("m")).filter("low < high")
        met = stored(rooted.join(pivots.select("slot", "key", F.col("m.node").alias("pivot"), F.col("m.root").alias("pivot_root")), ["slot", "key"]))
        often = met.filter("root <> pivot_root").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
        pairs = stored(often.groupBy("node").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("m")).select(F.col("node").alias("b"), (-F.col("m.p")).alias("a")))
        links = confirm(pairs, own, percent)
        labels = components(links, labels)
        tried, found = pairs.count(), links.count()
        discard(mates, pairs, links)
        mates = met.select("slot", "key", "node")
        mates._stored_at = met._stored_at
        rooted = mates if labels is None else mates.join(labels, "node", "left")
        rooted = rooted.withColumn("root", F.coalesce("root", "node") if labels is not None else F.col("node"))
        if not tried or GAIN * found < tried:
            break
        step += 1
    still = rooted.groupBy("slot", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    rest = stored(rooted.join(still.select("slot", "key"), ["slot", "key"], "left_semi"))
    if not rest.isEmpty():
        groups = _groups(rest).join(rest.select("node", "root").distinct(), "node")
        left = stored(own.join(groups, "node"))
        labels = components(_last_links(left, percent), labels)
        discard(left)
    discard(mates, rest, own)

    if not torn.isEmpty():
        labels = components(torn, labels)
    placed = sets.filter("doc_id is not null").select("doc_id", "n_shingles", "print").join(classes, "print", "left")
    if labels is not None:
        placed = placed.join(labels, "node", "left").withColumn("node", F.coalesce("root", "node"))
    found = F.coalesce("node", "doc_id")
    placed = placed.select("doc_id", "n_shingles", found.alias("component_id"), (found == F.col("doc_id")).alias("kept"))
    alone = sets.filter("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return placed.unionByName(alone)
