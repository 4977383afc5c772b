"""N-gram Jaccard self-join with prefix filters under several global token orders.

1. One pass hashes each text's distinct word shingles; texts with the same set share one *node*.
2. A second pass deals (shingle, node) out by shingle, packed into arrays. Each shingle that two or more
   nodes hold goes back to its nodes with its document frequency. A node whose prefix holds only
   shingles of its own can have no partner and drops out here; mostly these are nearly all nodes.
3. Candidates share a shingle of their prefixes under the first order, rare shingles first: a join on the shingle.
   The candidates are then joined with the nodes' prefixes under two more orders, which a hash decides and not
   frequency; only pairs that share enough there under both are joined with the sets and counted.
4. Pairs inside what is known to be one component are never made. A shingle of at most CROWD holders makes fewer
   than CROWD pairs for each of them. Holders of crowded shingles first compare themselves with a representative of the
   largest component there, as long as that connects many; what then is still in another component than most of
   its candidates meets them in tiles, which test all three orders and count without making a row for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.components import components
from notewright.llm.shared import drop, mix, pieces, small_batches, utf8, words_of, written

#: Nodes of one block of texts that a shingle needs to skip the exchange by shingle, and its class then.
HOT_IN_BLOCK, HOT = 64, 255
#: Text that is hashed at once, and shingles that are dealt out at once.
PIECE_BYTES, BLOCK_SHINGLES = 1 << 20, 2_800_000
#: Shingles of a part, on average, which one task sorts; nodes whose sets are unpacked at once.
PART_SHINGLES, NODES_AT_ONCE = 3_000_000, 64
#: Most pairs (two numbers each) to send to all tasks; more are joined by a shuffle.
MOST_SENT = 200_000
#: Holders up to which a shingle makes pairs; nodes and shingles of one side of a tile.
CROWD, TILE_NODES, TILE_SHINGLES = 32, 512, 1_000_000
#: A representative is tried while nodes outside would meet more than this many others on average, in so many rounds at most
#: and only while a round spares a fifth of the meetings. None of these changes what is found.
FEW_MEETINGS, MOST_ROUNDS = 20_000, 8
_ROLES = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_SALTS = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted in it, and the first of each text.

    A text with fewer than ``n`` words has one shingle, its whole sequence; one without words has none.
    """
    words = words_of(data, offsets, lower=True)
    roles = np.concatenate([_ROLES, mix(np.arange(1, max(n - 4, 1), dtype=np.uint64))])
    whole = mix(sum((words.hashes[k : len(words.hashes) - n + 1 + k] * roles[k] for k in range(n)), np.zeros(max(0, len(words.hashes) - n + 1), np.uint64))) if len(words.hashes) >= n else np.empty(0, np.uint64)
    sets = []
    for first, last in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if last - first >= n:
            found = np.sort(whole[first : last - n + 1])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif last > first:
            sets.append(mix(np.array([(words.hashes[first:last] * roles[: last - first]).sum() + np.uint64(last - first)], np.uint64)))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def node_ids(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, the same for equal sets; 0 for an empty one."""
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ s), dtype=np.uint64))) for s in _SALTS[1:]]
    a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
    size = np.diff(first).astype(np.uint64)
    ids = mix(a ^ mix(b + size))
    return np.where(size == 0, np.uint64(0), np.where(ids == 0, np.uint64(1), ids)).view(np.int64)


def set_sizes(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node) for every document."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, PIECE_BYTES):
            shingles, first = shingle_sets(*utf8(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(node_ids(shingles, first))], [id_col, "n_shingles", "node"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, f"`{id_col}` {id_type}, n_shingles long, node long")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)


_PACKED = "part int, nodes binary, counts binary, low binary, high binary, hot binary, hot_nodes binary, hot_counts binary, hot_shingles binary"


def _pack(shingles: np.ndarray, nodes: np.ndarray, parts: int) -> Iterator[list[object]]:
    """Rows of _PACKED for one block: for each part its nodes, how many shingles each has there and the shingles,
    40 bits each beside the part. Shingles that HOT_IN_BLOCK nodes of the block hold are announced to their part
    and go with their nodes to a part that the node decides."""
    order = np.argsort(shingles)
    runs = _runs(shingles[order])
    many = np.repeat(np.diff(runs) >= HOT_IN_BLOCK, np.diff(runs))
    hot = np.zeros(len(shingles), bool)
    hot[order] = many
    announced = shingles[order][runs[:-1]][np.diff(runs) >= HOT_IN_BLOCK]
    part = (shingles % np.uint64(parts)).astype(np.int64)

    def dealt(chosen: np.ndarray, to: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.flatnonzero(chosen)
        at = at[np.argsort(to[at], kind="stable")]  # nodes stay together inside a part
        cuts = _runs(to[at])
        out = {}
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = nodes[at[s:e]]
            r = _runs(own)
            out[int(to[at[s]])] = (own[r[:-1]], np.diff(r).astype(np.uint32), shingles[at[s:e]])
        return out

    cold, warm = dealt(~hot, part), dealt(hot, (nodes.view(np.uint64) % np.uint64(parts)).astype(np.int64))
    none = (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint64))
    announced_part = (announced % np.uint64(parts)).astype(np.int64)
    for p in sorted({*cold, *warm, *announced_part.tolist()}):
        (n, c, t), (hn, hc, ht) = cold.get(p, none), warm.get(p, none)
        kept = t // np.uint64(parts)
        yield [p, n.tobytes(), c.tobytes(), kept.astype(np.uint32).tobytes(), (kept >> np.uint64(32)).astype(np.uint8).tobytes(), _short(announced[announced_part == p], parts).tobytes(), hn.tobytes(), hc.tobytes(), _short(ht, parts).tobytes()]


def _classes(df: np.ndarray) -> np.ndarray:
    """Document frequencies in one byte: as they are up to 127, above by steps of a twelfth."""
    large = np.minimum(HOT - 1, 128 + (6 * np.log2(np.maximum(df, 128) / 128)).astype(np.int64))
    return np.where(df < 128, df, large).astype(np.uint8)


def _short(shingles: np.ndarray, parts: int) -> np.ndarray:
    """The shingle with the bits that the exchange keeps of it."""
    return _long(shingles // np.uint64(parts), (shingles % np.uint64(parts)), parts)


def _long(kept: np.ndarray, part: np.ndarray | int, parts: int) -> np.ndarray:
    return (kept & np.uint64((1 << 40) - 1)) * np.uint64(parts) + np.asarray(part, np.uint64)


def _shared_of_part(table: pa.Table, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the packed rows of one part: (node, shingle, class) of every shingle that two or more nodes hold."""
    col = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
    nodes = np.concatenate([np.repeat(n, c) for n, c in zip(col("nodes", np.int64), col("counts", np.uint32), strict=True)])
    low, high = np.concatenate(col("low", np.uint32)), np.concatenate(col("high", np.uint8))
    shingles = _long(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), table.column("part")[0].as_py(), parts)
    hot = np.unique(np.concatenate(col("hot", np.uint64)))
    order = np.argsort(shingles)
    shingles, nodes = shingles[order], nodes[order]
    again = np.zeros(len(shingles), bool)
    same = shingles[1:] == shingles[:-1]
    again[1:] |= same
    again[:-1] |= same
    is_hot = np.isin(shingles, hot) if len(hot) else np.zeros(len(shingles), bool)
    at = np.flatnonzero(again | is_hot)
    at = at[np.lexsort((nodes[at], shingles[at]))]
    t, n = shingles[at], nodes[at]
    new = np.ones(len(at), bool)  # the same set may come from many tasks
    new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
    t, n, h = t[new], n[new], is_hot[at][new]
    runs = np.diff(_runs(t))
    classes = np.where(h, HOT, _classes(np.repeat(runs, runs)))
    yield n[classes > 1], t[classes > 1], classes[classes > 1].astype(np.uint8)
    hot_nodes = np.concatenate([np.repeat(n, c) for n, c in zip(col("hot_nodes", np.int64), col("hot_counts", np.uint32), strict=True)])
    yield hot_nodes, np.concatenate(col("hot_shingles", np.uint64)), np.full(len(hot_nodes), HOT, np.uint8)


def shared_shingles(docs: DataFrame, parts: int, words: int, text_col: str) -> DataFrame:
    """(node, shared): for each node and part the shingles that other nodes hold too, with their frequency's class.
    Shingles are 40 bits beside their part; those that skipped the exchange have part -1 and all their bits."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in _PACKED.split(", ")]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: an equal set is sent once
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                rows = list(_pack(np.concatenate([s for s, _ in held]), np.concatenate([n for _, n in held]), parts))
                held.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names)

        size = 0
        for batch in pieces(batches, text_col, PIECE_BYTES):
            shingles, first = shingle_sets(*utf8(batch.column(0)), words)
            ids = node_ids(shingles, first)
            new = np.zeros(len(ids), bool)
            for i, x in enumerate(ids.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[i] = True
            wide = np.repeat(new, np.diff(first))
            held.append((shingles[wide], np.repeat(ids, np.diff(first))[wide]))
            size += len(held[-1][0])
            if size >= BLOCK_SHINGLES:
                yield from out()
                size = 0
        yield from out()

    def part(table: pa.Table) -> pa.Table:
        number = table.column("part")[0].as_py()
        got: list[list] = [[], [], [], [], []]
        for own, (nodes, shingles, classes) in zip((number, -1), _shared_of_part(table, parts), strict=True):
            order = np.argsort(nodes, kind="stable")
            runs = _runs(nodes[order])
            kept = shingles[order] // np.uint64(parts) if own >= 0 else shingles[order]
            low, high = (kept.astype(np.uint32), (kept >> np.uint64(32)).astype(np.uint8)) if own >= 0 else (kept, kept[:0].astype(np.uint8))
            c = classes[order]
            got[0].append(nodes[order][runs[:-1]])
            got[1] += [own] * (len(runs) - 1)
            for s, e in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
                got[2].append(low[s:e].tobytes())
                got[3].append(high[s:e].tobytes())
                got[4].append(c[s:e].tobytes())
        shared = pa.StructArray.from_arrays([pa.array(got[1], pa.int32()), *(pa.array(x, pa.binary()) for x in got[2:])], ["part", "low", "high", "classes"])
        return pa.table({"node": pa.array(np.concatenate(got[0])), "shared": shared})

    return docs.select(text_col).mapInArrow(blocks, _PACKED).groupBy("part").applyInArrow(part, "node long, shared struct<part int, low binary, high binary, classes binary>")


def fewest_shared(size: int, percent: int) -> int:
    """How many shingles of a set any set that is similar enough must share."""
    return -(-percent * size // 100)


def least_met(size: int, percent: int) -> int:
    """How many shingles must meet in the longer prefixes under the second and third order."""
    return min(1 + size // 8, fewest_shared(size, percent))


def prefixes(size: int, shingles: np.ndarray, classes: np.ndarray, percent: int) -> list[np.ndarray]:
    """The shingles that other nodes hold in the prefixes under each order, first ones first.

    Orders: rare first, equally rare ones by a hash; by a hash; by another hash. Shingles of the node's own come first in
    every order. Similar sets share ``want`` shingles or more of their first size - fewest_shared + want ones.
    """
    room = size - fewest_shared(size, percent) - (size - len(shingles))
    wants = (1, least_met(size, percent), least_met(size, percent))
    by = (np.lexsort((mix(shingles), classes)), np.argsort(mix(shingles ^ _SALTS[1])), np.argsort(mix(shingles ^ _SALTS[2])))
    return [shingles[o[: max(0, room + want)]] for o, want in zip(by, wants, strict=True)]


def _sets(batch: pa.RecordBatch, parts: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(node, size, shingles, classes) of each row."""
    out = []
    for node, size, shared in zip(*(batch.column(k).to_pylist() for k in ("node", "n_shingles", "shared")), strict=True):
        found = []
        for x in shared:
            if x["part"] < 0:
                found.append(np.frombuffer(x["low"], np.uint64))
            else:
                found.append(_long(np.frombuffer(x["low"], np.uint32).astype(np.uint64) | np.frombuffer(x["high"], np.uint8).astype(np.uint64) << np.uint64(32), x["part"], parts))
        t, first = np.unique(np.concatenate(found), return_index=True)
        out.append((node, size, t, np.frombuffer(b"".join(x["classes"] for x in shared), np.uint8)[first]))
    return out


_ORDERS = ("order0", "order1", "order2")


def node_sets(docs: DataFrame, sizes: DataFrame, n_shingles: int, words: int, percent: int, text_col: str) -> DataFrame:
    """(node, n_shingles, least_met, n_held, shingles, order0, order1, order2) of nodes that may have a partner.

    ``shingles`` are the n_held ones that other nodes hold too, the orders their prefixes.
    """
    parts = max(16, -(-n_shingles // PART_SHINGLES))
    back = shared_shingles(docs, parts, words, text_col)
    merged = back.groupBy("node").agg(F.sum(F.octet_length("shared.classes")).alias("_shared"), F.collect_list("shared").alias("shared"))
    live = merged.join(sizes.select("node", "n_shingles"), "node").where(f"n_shingles - _shared < n_shingles - ceil({percent} * n_shingles / 100) + 1")
    names = ["node", "n_shingles", "least_met", "n_held", "shingles", *_ORDERS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, NODES_AT_ONCE):
                sets = _sets(batch.slice(at, NODES_AT_ONCE), parts)
                arrays = [[s[2] for s in sets], *zip(*[prefixes(s[1], s[2], s[3], percent) for s in sets], strict=True)]
                numbers = zip(*[(s[0], s[1], least_met(s[1], percent), len(s[2])) for s in sets], strict=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in own]))), pa.int32()), pa.array(np.concatenate(own).view(np.int64))) for own in arrays]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), *lists], names)

    schema = ", ".join(f"{n} long" for n in names[:4]) + ", " + ", ".join(f"{n} array<long>" for n in names[4:])
    return written(live.select("node", "n_shingles", "shared").mapInArrow(work, schema), "nodes")


def _both(pairs: DataFrame, n: int, nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(a, b, of_a, of_b): pairs with those columns of both nodes. Each side meets the nodes by itself and the two sides meet
    by the pair, so a node of many pairs is no hot key there."""
    sent = F.broadcast(pairs) if n <= MOST_SENT else pairs
    side = lambda x: nodes.select(F.col("node").alias(x), F.struct(*columns).alias(f"of_{x}")).join(sent, x)
    return side("a").join(side("b"), ["a", "b"])


def _meets(order: str, percent: int) -> Column:
    """Whether the prefixes of a pair share enough shingles under an order. Both sizes say how many the sets must share, so
    the prefixes can be shorter than those kept for any partner: size - that + least_met, less the node's own shingles."""
    must = _must_share(F.col("of_a.n_shingles"), F.col("of_b.n_shingles"), percent)
    least = F.least("of_a.least_met", "of_b.least_met")
    first = lambda x: F.slice(f"of_{x}.{order}", F.lit(1), F.greatest(F.col(f"of_{x}.n_held") - must + least, F.lit(0)).cast("int"))
    return F.size(F.array_intersect(first("a"), first("b"))) >= least


def _must_share(a: Column, b: Column, percent: int) -> Column:
    """How many shingles similar sets of these sizes share at least."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _allowed(x: str, y: str, percent: int) -> Column:
    """Whether sizes, and what other nodes hold of both, let two nodes be similar; columns size_x, held_x and so on."""
    a, b = F.col(f"size_{x}"), F.col(f"size_{y}")
    return F.least(f"held_{x}", f"held_{y}", a, b) >= _must_share(a, b, percent)


def _similar(percent: int) -> Column:
    shared = F.size(F.array_intersect("of_a.shingles", "of_b.shingles"))
    return F.lit(100) * shared >= F.lit(percent) * (F.col("of_a.n_shingles") + F.col("of_b.n_shingles") - shared)


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs (a written table of candidates under the first order) that pass the other orders and are similar."""
    heads = _both(pairs, pairs.count(), nodes, ("n_shingles", "least_met", "n_held", *_ORDERS[1:]))
    left = written(heads.where(_meets("order1", percent) & _meets("order2", percent)).select("a", "b"), "filtered")
    out = written(_both(left, left.count(), nodes, ("n_shingles", "shingles")).where(_similar(percent)).select("a", "b"), "links")
    drop(left)
    return out


def links_of_tile(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links (node, smallest node) that connect what similar pairs of a tile connect: pairs of two labels, and of two sides
    where there are two. A pair is counted when the prefixes meet under every order, sizes and what other nodes hold
    allow it, and nothing connects it yet."""
    n = table.num_rows
    ids, label, side, size, held = (table.column(c).to_numpy() for c in ("node", "label", "side", "n_shingles", "n_held"))
    two_sides = side.min() != side.max()
    lists = lambda c: (table.column(c).combine_chunks().flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(table.column(c)).to_numpy()))))
    flat, first = lists("shingles")
    known, flat = np.unique(flat, return_inverse=True)
    # Prefixes in which one shingle must meet, as the number of a shingle in ``known`` by its holders.
    holders = []
    for order in _ORDERS:
        values, start = lists(order)
        length = np.minimum(np.diff(start), np.maximum(0, held - -(-percent * size // 100) + 1))
        at = np.repeat(start[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        shingle, who = np.searchsorted(known, values[at]), np.repeat(np.arange(n), length)
        by = np.argsort(shingle, kind="stable")
        holders.append((shingle, np.concatenate(([0], np.cumsum(length))), who[by], np.searchsorted(shingle[by], np.arange(len(known) + 1))))
    root, marked = np.unique(label, return_inverse=True)[1], np.zeros(len(known) + 1, bool)
    links = []
    for i in range(n - 1):
        near = root != root[i]
        near[: i + 1] = False
        if two_sides:
            near &= side != side[i]
        must = -(-percent * (size[i] + size) // (100 + percent))
        near &= (np.minimum(held, size) >= must) & (min(held[i], size[i]) >= must)
        for shingle, start, who, begin in holders:
            if not near.any():
                break
            met = np.zeros(n, bool)
            for t in shingle[start[i] : start[i + 1]].tolist():
                met[who[begin[t] : begin[t + 1]]] = True
            near &= met
        others = np.flatnonzero(near)
        if not len(others):
            continue
        marked[flat[first[i] : first[i + 1]]] = True
        lengths = first[others + 1] - first[others]
        ends = np.cumsum(lengths)
        shared = np.add.reduceat(marked[flat[np.arange(ends[-1]) + np.repeat(first[others] - (ends - lengths), lengths)]].astype(np.int64), ends - lengths)
        marked[flat[first[i] : first[i + 1]]] = False
        for j in others[100 * shared >= percent * (size[i] + size[others] - shared)].tolist():
            if root[j] != root[i]:
                links.append((int(ids[i]), int(ids[j])))
                root[root == root[j]] = root[i]
    return links


def crowded_links(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the holders of crowded shingles (shingle, node, label, main, rep) that lie in different components.

    Holders of one shingle, and of what they hold besides, are a group. Its nodes outside the group's largest
    component meet each other and those in it, in tiles of two blocks; no tile holds two blocks of that component.
    """
    groups = components(met.select(F.col("node").alias("a"), F.col("rep").alias("b")), label="crowds")
    held = nodes.select(F.col("node").alias("_n"), "n_held")
    members = written(groups.join(met.select("node", "label").distinct(), "node").join(held, F.col("node") == F.col("_n")).drop("_n"), "crowds")
    labels = members.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_held").alias("held"))
    blocks = lambda n, h: F.ceil(F.greatest(n / TILE_NODES, h / TILE_SHINGLES)).cast("int")
    largest = labels.groupBy("root").agg(F.max_by(F.struct("label", "n", "held"), F.struct("n", F.bitwise_not("label"))).alias("main"), F.sum("n").alias("n"), F.sum("held").alias("held"))
    cuts = largest.where(F.col("n") > F.col("main.n")).select(F.col("root").alias("_r"), F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.held")).alias("ins"), blocks(F.col("n") - F.col("main.n"), F.col("held") - F.col("main.held")).alias("outs"))
    placed = members.join(cuts, F.col("root") == F.col("_r")).withColumn("out", (F.col("label") != F.col("main")).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("out") == 1, F.col("outs")).otherwise(F.col("ins"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    tile = lambda a_out, a, b: F.struct(F.lit(a_out).alias("out"), a.alias("a"), b.alias("b"))
    with_outs = F.transform(upto("outs"), lambda k: F.when(F.col("out") == 1, tile(1, F.least(k, F.col("own")), F.greatest(k, F.col("own")))).otherwise(tile(0, F.col("own"), k)))
    with_ins = F.when(F.col("out") == 1, F.transform(upto("ins"), lambda k: tile(0, k, F.col("own"))))
    sent = placed.withColumn("own", own).select("root", "node", "label", "out", "own", F.explode(F.concat(with_outs, F.coalesce(with_ins, F.array().cast("array<struct<out:int,a:int,b:int>>")))).alias("t"))
    sent = sent.select("node", "label", F.when(F.col("t.out") == 1, F.col("own")).otherwise(-F.col("out")).alias("side"), F.xxhash64("root", "t").alias("tile"))

    def work(table: pa.Table) -> pa.Table:
        links = links_of_tile(table, percent)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    rows = sent.join(nodes.select("node", "n_shingles", "n_held", "shingles", *_ORDERS), "node")
    out = written(rows.groupBy("tile").applyInArrow(work, "a long, b long"), "links")
    drop(members)
    return out


def similar_links(nodes: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of (a, b): links that connect the nodes of ``node_sets`` as all similar pairs do."""
    rows = written(nodes.select(F.explode("order0").alias("shingle"), "node", F.col("n_shingles").alias("size"), F.col("n_held").alias("held"), F.col("node").alias("label")), "prefixes")
    before, found = float("inf"), []
    for number in range(MOST_ROUNDS):
        # Of a shingle: its holders, the label most of them have, and one of these as representative.
        if number == 0:  # each node is its own label
            mains = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"), F.min("node").alias("main"), F.min("node").alias("rep")).where("holders > 1")
        else:
            labels = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"), F.min_by("node", F.xxhash64("node", F.lit(number))).alias("rep"))
            mains = labels.groupBy("shingle").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("holders"), F.max_by(F.struct("label", "rep"), F.struct("n", F.bitwise_not("label"))).alias("m")).where("labels > 1").select("shingle", "holders", F.col("m.label").alias("main"), F.col("m.rep").alias("rep"))
        met = written(rows.join(mains, "shingle"), "open")
        drop(rows)
        crowded = met.where(f"holders > {CROWD}")
        outside = crowded.where("label <> main").groupBy("node").agg(F.max("holders").alias("n"))
        meetings, n_outside = outside.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        if meetings <= FEW_MEETINGS * n_outside or meetings > 0.8 * before or number == MOST_ROUNDS - 1:
            break
        before = meetings
        tried = crowded.where("label <> main").groupBy("node", "label").agg(F.min_by(F.struct("rep", "main"), F.xxhash64("rep", F.lit(number))).alias("r"))
        tried = written(tried.select(F.least("node", "r.rep").alias("a"), F.greatest("node", "r.rep").alias("b"), "label", F.col("r.main").alias("main")), "tried")
        links = verified(tried.select("a", "b"), nodes, percent)
        found.append(links)
        # The smallest label within three steps: nodes with one label are connected.
        edges = tried.join(links, ["a", "b"]).select(F.col("label").alias("u"), F.col("main").alias("v"))
        edges = written(edges.union(edges.select("v", "u")).distinct(), "label-links")
        near = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        for _ in range(2):
            near = edges.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
        near = written(near.select(F.col("u").alias("label"), "m"), "labels")
        rows = written(met.join(near, "label", "left").select("shingle", "node", "size", "held", F.coalesce("m", "label").alias("label")), "prefixes")
        drop(met, tried, edges, near)
    few_holders = met.where(f"holders <= {CROWD}")
    side = lambda x: few_holders.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "held", "label")], (F.col("label") == F.col("main")).alias(f"inside_{x}"))
    apart = (F.col("label_x") != F.col("label_y")) & (F.col("inside_y") | (F.col("node_x") < F.col("node_y")))
    pairs = side("x").where("not inside_x").join(side("y"), "shingle").where(apart & _allowed("x", "y", percent))
    pairs = written(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "candidates")
    found.append(verified(pairs, nodes, percent))
    if meetings:
        found.append(crowded_links(crowded, nodes, percent))
    drop(met, pairs)
    return found


def _prepared(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sizes of all documents, those of the nodes, and the sets of nodes that may have a partner."""
    sized = written(set_sizes(docs, words, id_col, text_col), "sets")
    sizes = sized.where("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.min(id_col).alias("_least"))
    total = sized.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    return sized, sizes, node_sets(docs, sizes, total, words, percent, text_col)


def filter_counts(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """A report: pairs of different sets that share a prefix shingle under the first order and whose sizes allow it, what
    the second and the third order leave of them, and how many are similar. It makes all pairs, so it is no part of the join.
    """
    _, _, nodes = _prepared(docs, words, percent, id_col, text_col)
    side = lambda x: nodes.select(F.explode("order0").alias("shingle"), F.col("node").alias(x), F.col("n_shingles").alias(f"size_{x}"))
    sizes_allow = F.least("size_a", "size_b") >= _must_share(F.col("size_a"), F.col("size_b"), percent)
    pairs = written(side("a").join(side("b"), "shingle").where((F.col("a") < F.col("b")) & sizes_allow).select("a", "b").distinct(), "candidates")
    n = pairs.count()
    met = _both(pairs, n, nodes, ("n_shingles", "least_met", "n_held", "shingles", *_ORDERS[1:])).withColumns({"second": _meets("order1", percent), "third": _meets("order2", percent), "similar": _similar(percent)})
    counts = met.agg(F.count_if("second").alias("second"), F.count_if(F.col("second") & F.col("third")).alias("both"), F.count_if("similar").alias("similar"), F.count_if(F.col("similar") & ~(F.col("second") & F.col("third"))).alias("lost")).first()
    return {"first order": n, "second order": counts["second"], "third order": counts["both"], "similar": counts["similar"], "lost": counts["lost"]}


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents whose shingle sets have 100 * intersection >= percent * union are linked; one row a document:
    the id, n_shingles, component_id (smallest id reachable by links, its own included).

    Words are split at ASCII blanks after A-Z are lower-cased. Null and empty texts and texts without words have
    no shingle and no link. Repeated rows and equal sets are one node and linked. A null id counts for no
    component_id: its row has the smallest other id of its component, or null. Empty tables give no row. No other
    column is read. Needs an integer id. Sets are compared by 64-bit hashes of words, of which 40 bits beside the part's
    number go through the exchange.
    """
    sized, sizes, nodes = _prepared(docs, words, percent, id_col, text_col)
    links = similar_links(nodes, percent)
    linked = links[0]
    for more in links[1:]:
        linked = linked.union(more)
    roots = written(components(linked, label="similar"), "roots")
    drop(nodes, *links)
    classes = sizes.join(roots, "node", "left").select("node", "_least", F.coalesce("root", "node").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("_least").alias("_lowest"))
    by_node = classes.join(lowest, "root").select("node", "_lowest")
    return sized.join(by_node, "node", "left").select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_lowest")).otherwise(F.col(id_col)).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id; of repeated rows of an id one stays.

    Texts without words are linked with nothing and stay. Rows with a null id cannot be named, so they are not
    compared and stay. The caller's columns travel in a struct, so they may have any names.
    """
    named = docs.where(F.col(id_col).isNotNull())
    first = jaccard_components(named, words, percent, id_col=id_col, text_col=text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("first")).distinct()
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    kept = rows.join(first, F.col("id") == F.col("first"), "left_semi").dropDuplicates(["id", "key"]).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return kept.union(docs.where(F.col(id_col).isNull()))
