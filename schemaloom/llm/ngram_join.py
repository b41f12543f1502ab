"""Documents whose shingle sets have a Jaccard similarity of 75 % or more, by token-combination prefixes.

Tokens are 5-word shingles. A count sketch over all documents, which grows with their text up to a bound, gives each token a
frequency level, which orders tokens (rare first) and parts them into a rare and a frequent class. Of n tokens a set can
lose at most n - ceil(0.75 n) to a similar one. A prefix in that order is long enough when losing so many of
its tokens still leaves either one rare token, or two frequent tokens of one subclass: r rare tokens
and c_j frequent ones in subclass j outlast r + sum(c_j - 1) - 1 losses, so the prefix is extended until that
sum passes the limit. Indexed are its rare tokens one by one and the pairs of its frequent tokens within
a subclass; two similar sets always share one of these. Subclasses follow the size of the set (powers of two;
sets near a boundary index for both sides), so pairs stay in proportion to the prefix.

Equal sets are one node, whatever their number. Index entries are dealt out by signature in packed
blocks; a task hands on one entry per signature and block of work, the other entries of a signature it
already knows to be shared go past the exchange's groups. An entry also says how far down the prefix it lies,
which rules out pairs whose sizes would need it nearer the front. Under a signature, the smallest node of about one size leads the others. A node is compared with the leader
it shares most signatures with, then with the next best that still lie in other components; where nodes of one signature then lie in different
components, every pair across these is compared as well (signatures of the same nodes count once): pair by pair, or, where a signature has many nodes, by tiles
of a crowd: all nodes that such signatures join, or each signature's own, whichever moves fewer sets. So no pair that
could change a component goes untested, and pairs inside a component need no test.

Ids only name components. Sets are verified by node and rows are known by id and text number, so null ids and
ids that stand on several texts neither lose links nor rows.

Defined results: null and blank texts have an empty set, n_shingles 0 and no link; their component is their own
id. Repeated rows share a component. Null ids never name a component if another member has an id. Only the
id and text columns are read; ``keep_one`` returns the input's columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, dropped_shuffles, lean, ship
from .common import components, cut, small, tasks
from .shingles import mix, set_number, shingle_sets
from .tokens import pieces_of

# Similarity in hundredths.
SIMILAR = 75
# Counters of the frequency sketch, least and most (it is sent to every task, a byte a counter), bytes of text for each, and
# counters in a slice. With too few, chance load hides passages that many documents share, and these chain in crowds.
COUNTERS, MOST_COUNTERS, COUNTER_BYTES, SLICE = 1 << 20, 1 << 24, 64, 1 << 16
# Documents beyond a counter's mean load (and its chance deviation) that mark its tokens as frequent.
FREQUENT = 32
# Logarithm of the ratio of sizes that share a leader (they are tried first; all others follow).
BAND = 0.1
# Index entries a task holds before it hands them on, and entries wanted in one group of the exchange.
HELD, GROUP = 400_000, 400_000
# Entries of a signature beyond which its nodes are compared as a crowd, nodes and shingles of a crowd's tile, tiles of a crowd
# from which on they hold more nodes (up to so many times), and bits of the widest parity row.
CROWD, TILE, TILE_SHINGLES, TILES, MOST_BITS = 32, 512, 2_000_000, 8, 1 << 16
# Characters of text worked on at once (texts are never cut).
CHARS = 250_000


def text_key(text: str) -> Column:
    """One 64-bit number for a text as it stands: other texts differ but for chance (2^-64 a pair)."""
    return F.xxhash64(F.col(text))


def counters(docs: DataFrame) -> int:
    """Counters of the sketch for the text there is, a power of two."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    return min(MOST_COUNTERS, max(COUNTERS, 1 << (total // COUNTER_BYTES).bit_length()))


def profile(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(id, key, n, node) of every document, written, and the sketch over all of them, see ``levels`` and ``first_frequent``."""
    width = counters(docs)

    def run(batches):
        # a task counts up to 255, which is frequent at any load
        counts = np.zeros(width, np.uint8)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in pieces_of(texts, CHARS):
                sets = shingle_sets(texts[a:b])
                met, times = np.unique((np.concatenate(sets) & np.uint64(width - 1)).astype(np.int64), return_counts=True)
                counts[met] = np.minimum(counts[met] + times, 255)
                yield pd.DataFrame({"id": batch["id"].iloc[a:b].to_numpy(), "named": batch["named"].iloc[a:b].to_numpy(),
                                    "key": batch["key"].iloc[a:b].to_numpy(), "n": [len(s) for s in sets],
                                    "node": pd.Series([set_number(s) if len(s) else None for s in sets], dtype=object), "slice": None, "counts": None})
        if counts.any():
            parts = [zlib.compress(counts[k:k + SLICE], 1) for k in range(0, width, SLICE)]
            yield pd.DataFrame({"id": None, "named": None, "key": None, "n": None, "node": None, "slice": range(len(parts)), "counts": parts})

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch["slice"], batch["counts"], strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(part), np.uint8).astype(np.uint32)
        yield pd.DataFrame({"slice": list(sums), "load": [int(s.sum(dtype=np.uint64)) for s in sums.values()], "levels": [levels(s).tobytes() for s in sums.values()]})

    # ids stay whole numbers beside nulls (pandas would turn them to floats)
    whole = docs.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("named"), "key", "text")
    made = cut_lineage(whole.mapInPandas(lean(run), "id bigint, named boolean, key bigint, n bigint, node bigint, slice int, counts binary"))
    level, load = np.zeros(width, np.uint8), 0
    slices = made.where("slice is not null").select("slice", "counts").repartition(width // SLICE, "slice")
    with dropped_shuffles(docs.sparkSession):
        found = slices.mapInPandas(lean(added), "slice int, load bigint, levels binary").collect()  # MOST_COUNTERS bytes at most
    for row in found:
        level[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.frombuffer(row["levels"], np.uint8)
        load += row["load"]
    return made.where("slice is null").select(F.when(F.col("named"), F.col("id")).alias("id"), "key", "n", "node"), level, first_frequent(load / width)


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequency level per counter (twice its binary logarithm)."""
    return np.floor(2 * np.log2(np.maximum(counts, 1).astype(np.float64))).astype(np.uint8)


def first_frequent(mean: float) -> int:
    """The first frequent level, for the counters' mean load."""
    mean = max(1.0, mean)
    return int(np.ceil(2 * np.log2(mean + 6 * np.sqrt(mean) + FREQUENT)))


def most_lost(n: int, similar: int = SIMILAR) -> int:
    return n - -(-n * similar // 100)


def signatures(shingles: np.ndarray, level: np.ndarray, frequent: int, similar: int = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signatures of one set, and for each the number of losses its prefix place makes up for.

    A signature is in the prefix that outlasts k - 1 losses exactly if its number is k at most.
    """
    n = len(shingles)
    if not n:
        return shingles, np.zeros(0, np.int32)
    size, need = n.bit_length() - 1, most_lost(n, similar) + 1
    sizes = [size, size + 1] if n * 100 >= similar << (size + 1) else [size]
    spread = mix(shingles)
    own = level[(shingles & np.uint64(len(level) - 1)).astype(np.int64)]
    key = (own.astype(np.uint64) << np.uint64(56)) | (spread >> np.uint64(8))
    longest = min(n, need + max(1, (1 << sizes[-1]) // 12))
    order = np.argpartition(key, longest - 1)[:longest] if longest < n else np.arange(n)
    order = order[np.argsort(key[order])]
    own, tokens = own[order], spread[order]
    often = own >= frequent
    where = np.flatnonzero(often)
    sigs, places = [], []
    for at in sizes:
        counts = np.ones(longest, np.int32)
        if len(where):
            # a frequent token counts when its subclass has been met before
            kind = (tokens[where] % np.uint64(max(1, (1 << at) // 12))).astype(np.int64)
            counts[where[np.unique(kind, return_index=True)[1]]] = 0
        place = np.cumsum(counts) - counts + 1
        end = int(np.searchsorted(place, need, side="right"))
        rare = ~often[:end]
        sigs.append(mix(tokens[:end][rare] + np.uint64(1)))
        places.append(place[:end][rare])
        late = where[where < end]
        if len(late):
            by = np.lexsort((late, kind[:len(late)]))
            late, bounds = late[by], np.flatnonzero(np.diff(kind[by], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    x, y = tokens[late[a + i]], tokens[late[a + j]]
                    sigs.append(mix(mix(np.minimum(x, y) + np.uint64(at)) + np.maximum(x, y)))
                    places.append(place[late[a + j]])
    sigs, places = np.concatenate(sigs), np.concatenate(places)
    first = np.lexsort((places, sigs))
    sigs, places = sigs[first], places[first]
    keep = np.concatenate([[True], sigs[1:] != sigs[:-1]])[:len(sigs)]
    return sigs[keep], places[keep].astype(np.int32)


ENTRY = np.dtype([("sig", "<u8"), ("node", "<i8"), ("n", "<i4"), ("place", "<i4")])


def shared_signatures(docs: DataFrame, level: np.ndarray, frequent: int, groups: int, similar: int = SIMILAR) -> DataFrame:
    """(sig, node, n, place) of every signature that two or more different sets have, written."""
    table = docs.sparkSession.sparkContext.broadcast(level)  # one byte per counter

    def rows(bucket, kind, entries):
        """One packed row per bucket, column by column, for entries in any order."""
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(bucket))
        packed = [b"".join(entries[c][a:b].tobytes() for c in ENTRY.names) for a, b in zip(cuts, ends, strict=True)]
        return pd.DataFrame({"bucket": bucket[cuts], "kind": kind, "entries": packed})

    def unpacked(data):
        count, at, out = len(data) // ENTRY.itemsize, 0, None
        out = np.empty(count, ENTRY)
        for c in ENTRY.names:
            out[c] = np.frombuffer(data, ENTRY[c], count, at)
            at += count * ENTRY[c].itemsize
        return out

    def ordered(entries):
        """By signature and node, one entry for each pair of these."""
        entries = entries[np.lexsort((entries["node"], entries["sig"]))]
        sig, node = entries["sig"], entries["node"]
        entries = entries[np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])])[:len(entries)]]
        return entries, np.concatenate([[True], entries["sig"][1:] != entries["sig"][:-1]])[:len(entries)]

    def handed(held):
        entries = np.empty(sum(len(s) for s, _, _, _ in held), ENTRY)
        sizes = [len(s) for s, _, _, _ in held]
        entries["sig"] = np.concatenate([s for s, _, _, _ in held])
        entries["place"] = np.concatenate([p for _, p, _, _ in held])
        entries["node"] = np.repeat(np.array([x for _, _, x, _ in held], np.int64), sizes)
        entries["n"] = np.repeat(np.array([n for _, _, _, n in held], np.int32), sizes)
        entries, first = ordered(entries)
        alone = first & np.append(first[1:], True)[:len(first)]
        bucket = ((entries["sig"] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        for kind, chosen in ((0, alone), (1, first & ~alone)):
            if chosen.any():
                yield rows(bucket[chosen], kind, entries[chosen])
        if not first.all():
            # the signature is known to be shared here; these entries are dealt out evenly
            rest = entries[~first]
            yield rows(rest["node"] % groups, 2, rest)

    def run(batches):
        held, size, by_counter = [], 0, table.value
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in pieces_of(texts, CHARS):
                for shingles in shingle_sets(texts[a:b]):
                    if len(shingles):
                        held.append((*signatures(shingles, by_counter, frequent, similar), set_number(shingles), len(shingles)))
                        size += len(held[-1][0])
                if size >= HELD:
                    yield from handed(held)
                    held, size = [], 0
        if size:
            yield from handed(held)

    def met(frame):
        parts = [unpacked(x) for x in frame["entries"]]
        kinds = np.repeat(frame["kind"].to_numpy(), [len(x) for x in parts])
        entries = np.concatenate(parts)
        past = entries[kinds == 2]
        known = np.unique(entries["sig"][kinds == 1])
        own, first = ordered(entries[kinds != 2])
        single = first & np.append(first[1:], True)[:len(first)]
        kept = np.concatenate([own[~single | np.isin(own["sig"], known)], past])
        return pd.DataFrame({"sig": kept["sig"].view(np.int64) if kept["sig"].flags.c_contiguous else kept["sig"].astype(np.int64),
                             "node": kept["node"], "n": kept["n"], "place": kept["place"]})

    packed = docs.mapInPandas(lean(run), "bucket bigint, kind int, entries binary")
    return cut_lineage(packed.groupBy("bucket").applyInPandas(lean(met), "sig bigint, node bigint, n int, place int"))


def may_link(similar: int = SIMILAR):
    """Of two entries (n, place) and (n_b, place_b) of one signature: whether the places allow a link by it.

    Two sets link with an overlap of at least o = ceil(similar (n + n_b) / (100 + similar)), so either loses its size
    less o, and they share a signature whose places are both within these losses plus one.
    """
    overlap = F.ceil(F.lit(similar) * (F.col("n") + F.col("n_b")) / F.lit(100.0 + similar) - 1e-9)
    return (F.col("place") <= F.col("n") - overlap + 1) & (F.col("place_b") <= F.col("n_b") - overlap + 1)


def parity(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One row of bits (a power of two) per set: whether an odd number of its tokens fall on each.

    Two rows differ in at most as many bits as tokens lie in only one of the sets.
    """
    return np.stack([np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)) for s in sets]).view(np.uint64)


def parity_bits(size: int) -> int:
    """Width of the parity row of a set of this size, about four bits a token."""
    return min(MOST_BITS, 256 << max(0, (size // 64).bit_length()))


def group_pairs(sized: list[np.ndarray], nodes: np.ndarray, sides: np.ndarray, similar: int = SIMILAR):
    """Pairs (a, b) of a group's rows of side 0 and 1 which their parity rows do not rule out as links.

    A row is the size of its set and its parity row; the wider one of two is folded to the other's width.
    """
    sizes, rows, pairs = np.array([r[0] for r in sized]), [r[1:].view(np.uint64) for r in sized], []
    widths = np.array([len(r) for r in rows])

    def folded(table, width):
        while table.shape[1] > width:
            table = table[:, :table.shape[1] // 2] ^ table[:, table.shape[1] // 2:]
        return table

    for width in np.unique(widths[sides == 1]):
        others = np.flatnonzero((sides == 1) & (widths == width))
        table = np.stack([rows[j] for j in others])
        for i in np.flatnonzero(sides == 0):
            least = min(width, widths[i])
            both = sizes[others] + sizes[i]
            differ = np.bitwise_count(folded(table, least) ^ folded(rows[i][None], least)).sum(axis=1, dtype=np.int64)
            top = np.minimum((both - differ) // 2, np.minimum(sizes[others], sizes[i]))
            pairs += [(int(nodes[i]), int(nodes[j])) for j in others[100 * top >= similar * (both - top)]]
    return pairs


def group_links(sets: list[np.ndarray], nodes: np.ndarray, parts: np.ndarray, sides: np.ndarray, similar: int = SIMILAR):
    """Links (a, b) between the parts of one group, as many as connect what any of its pairs connects.

    Rows of side 0 are compared with those of side 1, rows of side 2 with each other. Pairs that differ in too many
    bits are no links; the others are tested on their whole sets, a row's most similar first, unless already connected.
    """
    sizes, parts, links = np.array([len(s) for s in sets], np.int64), np.array(parts, np.int64), []
    table = parity([mix(s) for s in sets], parity_bits(int(sizes.max())))
    for i in np.flatnonzero(sides != 1):
        others = np.flatnonzero(sides == 1) if sides[i] == 0 else np.flatnonzero(sides[i + 1:] == 2) + i + 1
        least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(parts[others] != parts[i]) & (100 * least >= similar * most)]
        if not len(others):
            continue
        both = sizes[others] + sizes[i]
        top = (both - np.bitwise_count(table[others] ^ table[i]).sum(axis=1, dtype=np.int64)) // 2
        may = np.flatnonzero(100 * top >= similar * (both - top))
        for j in others[may[np.argsort(-top[may] / both[may], kind="stable")]]:
            if parts[i] != parts[j]:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common * 100 >= (sizes[i] + sizes[j] - common) * similar:
                    parts[parts == parts[j]] = parts[i]
                    links.append((int(nodes[i]), int(nodes[j])))
    return links


def linked(wanted: DataFrame, docs: DataFrame, similar: int = SIMILAR, rows: bool = False) -> DataFrame:
    """Links (a, b) by group, written; ``wanted`` has (grp, side, part, key, n), see ``group_links``.

    Sets are made anew from whole texts of the nodes needed and go straight to their groups, in one exchange. With
    ``rows`` their parity rows go instead, and the pairs come back that may be links, see ``group_pairs``.
    """
    wanted = cut_lineage(wanted.select("grp", "side", "part", "key", "n"))
    total = wanted.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # a parity row has about a sixteenth of its set's bytes
    deal = max(2 * tasks(docs.sparkSession), total["n"] // (16 * GROUP if rows else GROUP))
    by_key = cut(wanted.groupBy("key").agg(F.collect_list(F.struct("grp", "side", "part")).alias("at")), total["rows"])

    def sent(own):
        if not rows:
            return own.view(np.int64)
        return np.append(np.int64(len(own)), parity([mix(own)], parity_bits(len(own)))[0].view(np.int64))

    def run(batches):
        made = set()
        for batch in batches:
            # copies of one text in a task are one set
            batch = batch[~batch["key"].isin(made)].drop_duplicates("key")
            made.update(batch["key"])
            texts, at = batch["text"].tolist(), [batch[c].tolist() for c in ("grp", "side", "part")]
            for a, b in pieces_of(texts, CHARS):
                dealt = []
                for own, gs, ss, ps in zip(shingle_sets(texts[a:b]), *(x[a:b] for x in at), strict=True):
                    node, numbers = set_number(own), sent(own)
                    dealt += [(g, s, p, node, numbers) for g, s, p in zip(gs, ss, ps, strict=True)]
                yield pd.DataFrame(dealt, columns=["grp", "side", "part", "node", "numbers"])

    def compared(frame):
        frame = frame.drop_duplicates(["grp", "side", "node"])
        links = []
        for _, own in frame.groupby("grp"):
            numbers, nodes, sides = [np.asarray(x, np.int64) for x in own["numbers"]], own["node"].to_numpy(), own["side"].to_numpy()
            if rows:
                links += group_pairs(numbers, nodes, sides, similar)
            elif len(own) > 1:
                links += group_links([x.view(np.uint64) for x in numbers], nodes, own["part"].to_numpy(), sides, similar)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    texts = docs.select("key", "text").join(small(by_key), "key").select("key", "text", "at.grp", "at.side", "at.part")
    made = texts.mapInPandas(lean(run), "grp bigint, side int, part bigint, node bigint, numbers array<bigint>")
    return cut_lineage(made.groupBy(F.pmod("grp", F.lit(deal)).alias("bucket")).applyInPandas(lean(compared), "a bigint, b bigint"))


def starred(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What ``linked`` wants for pairs (a, b): those of one ``a`` in groups of about ``TILE``."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    dealt = pairs.select("a", "b").join(chunks, "a").withColumn("grp", F.xxhash64("a", F.pmod(F.xxhash64("b"), "chunks")))
    ends = (dealt.select("grp", F.lit(0).alias("side"), F.col("a").alias("node")).distinct()
            .unionAll(dealt.select("grp", F.lit(1).alias("side"), F.col("b").alias("node"))))
    return ends.join(nodes, "node").withColumn("part", F.col("node"))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written.

    Pairs meet as parity rows first, so whole sets travel only for those that may be links.
    """
    may = linked(starred(pairs, nodes), docs, similar, rows=True)
    return linked(starred(may, nodes), docs, similar)


def tiled(nodes: str, shingles: str) -> Column:
    """Number of a crowd's tiles: ``TILES`` of about ``TILE`` nodes at most, then larger ones up to ``TILES`` times that."""
    many = F.greatest(F.least(F.ceil(F.col(nodes) / TILE), F.lit(TILES).cast("bigint")), F.ceil(F.col(nodes) / (TILE * TILES)))
    return F.greatest(many, F.ceil(F.col(shingles) / TILE_SHINGLES))


def crowds(members: DataFrame) -> DataFrame:
    """(crowd, node, part, n, tiles), written; ``members`` has (sig, lead, node, part, n), ``lead`` one node a signature.

    Signatures that share nodes are one crowd, unless the sets sent to its tiles are more than those sent when each signature is a
    crowd of its own: passages met in many documents may chain signatures that have little else in common.
    """
    joined = components(members.select(F.col("lead").alias("a"), F.col("node").alias("b")))
    rows = cut_lineage(members.select("sig", "node", "part", "n").join(joined, "node"))
    size = [F.count(F.lit(1)).alias("entries"), F.sum("n").alias("shingles")]
    sent = F.col("entries") * tiled("entries", "shingles")
    apart = rows.groupBy("component", "sig").agg(*size).groupBy("component").agg(F.sum(sent).alias("apart"))
    whole = rows.select("component", "node", "n").distinct().groupBy("component").agg(*size).select("component", sent.alias("whole"))
    # one row a crowd, sent to all tasks: a large crowd's rows are not dealt out by crowd
    kinds = small(cut_lineage(apart.join(whole, "component").select("component", (F.col("apart") < F.col("whole")).alias("split"))))
    crowd = F.when(F.col("split"), F.xxhash64("component", "sig")).otherwise(F.xxhash64("component")).alias("crowd")
    own = cut_lineage(rows.join(kinds, "component").select(crowd, "node", "part", "n").distinct())
    tiles = cut_lineage(own.groupBy("crowd").agg(*size).select("crowd", tiled("entries", "shingles").alias("tiles")))
    return cut_lineage(own.join(small(tiles), "crowd"))


def crowd_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links that connect all parts of ``crowds``, written.

    A crowd's nodes are dealt into tiles of bounded number and size, any two of which meet in one group, so that no pair is
    a row of a join.
    """
    dealt = (crowds(members).join(nodes.select("node", "key"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))))
    side = F.when(F.col("tile") == F.col("other"), 2).when(F.col("tile") < F.col("other"), 0).otherwise(1)
    group = F.xxhash64("crowd", F.least("tile", "other"), F.greatest("tile", "other"))
    return linked(dealt.withColumns({"grp": group, "side": side}), docs, similar)


def open_signatures(index: DataFrame, part: DataFrame, size: int) -> DataFrame:
    """(sig, node, n, place, part) of the signatures whose nodes lie in different components, written.

    Signatures of the same nodes are one, with each node's foremost place: two sets that share a long passage meet in
    one row, not in one for each signature of it. Were two different groups of nodes to get one digest, they would be
    compared as one, which loses no pair.
    """
    placed = cut_lineage(index.join(part, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"))
    alike = F.xxhash64(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node"))).alias("alike")
    kinds = cut(placed.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), alike)
                .where("lo != hi").select("sig", "alike"), size)
    met = placed.join(kinds, "sig").groupBy(F.col("alike").alias("sig"), "node")
    return cut_lineage(met.agg(F.first("n").alias("n"), F.min("place").alias("place"), F.first("part").alias("part")))


def placed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(id, key, n, node, first), one row per row; ``first`` is the group's leader: its id, node and text, ids before null."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"), text_key(text).alias("key"))
    seen, level, frequent = profile(own)
    totals = seen.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    nodes = cut(seen.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("rep")),
                totals["rows"])
    deal = max(2 * tasks(docs.sparkSession), totals["shingles"] // 3 // GROUP)
    index = shared_signatures(own, level, frequent, deal, similar)
    # under each signature the smallest node of a size band leads; a node meets the leader it shares most with first
    banded = index.withColumn("band", F.floor(F.log("n") / BAND))
    lead = banded.groupBy("sig", "band").agg(F.min_by(F.struct("node", "n", "place"), "node").alias("lead"))
    size = index.count()
    led = (banded.join(lead, ["sig", "band"]).where("node != lead.node")
           .withColumns({"a": F.col("lead.node"), "n_b": F.col("lead.n"), "place_b": F.col("lead.place")}))
    stars = cut(led.groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max(may_link(similar)).alias("ok"))
                .where("ok"), size)
    first = cut(stars.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"), F.max("k").alias("most")), size)
    links = verified(first.select("a", "b"), nodes, own, similar)
    # the other leaders, where they still lie in another component
    part = components(links)
    a_part = part.select(F.col("node").alias("a"), F.col("component").alias("a_part"))
    b_part = part.select(F.col("node").alias("b"), F.col("component").alias("b_part"))
    apart = F.coalesce("a_part", "a") != F.coalesce("b_part", "b")
    rest = stars.join(first.select("b", "most"), "b").where("2 * k >= most").select("a", "b")
    rest = rest.join(first, ["a", "b"], "leftanti").join(a_part, "a", "left").join(b_part, "b", "left").where(apart)
    rest = cut(rest.select("a", "b"), size)
    links = links.unionAll(verified(rest, nodes, own, similar))
    tested = first.select("a", "b").unionAll(rest)
    # at last all pairs across components under one signature
    left = open_signatures(index, components(links), size)
    # signatures of many nodes by crowds, the others pair by pair
    crowded = cut(left.groupBy("sig").agg(F.count(F.lit(1)).alias("entries"), F.min("node").alias("lead"))
                  .where(F.col("entries") > CROWD).select("sig", "lead"), size)
    few = left.join(crowded, "sig", "leftanti")
    right = few.select("sig", F.col("node").alias("other"), F.col("n").alias("n_b"), F.col("place").alias("place_b"),
                       F.col("part").alias("other_part"))
    across = (few.join(right, "sig").where("part < other_part").where(may_link(similar))
              .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
              .join(tested, ["a", "b"], "leftanti"))
    across = cut_lineage(across)
    more = verified(across, nodes, own, similar) if not across.isEmpty() else links.limit(0)
    if not crowded.isEmpty():
        more = more.unionAll(crowd_links(left.join(crowded, "sig"), nodes, own, similar))
    final = components(links.unionAll(more))
    named = nodes.drop("n").join(final, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min(F.struct("rep.unnamed", "rep.id", "node", "rep.key")).alias("first"))
    names = cut(named.join(least, "component").select("node", "first"), totals["rows"])
    return seen.join(names, "node", "left").select("id", "key", "n", "node", "first")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """(id, n_shingles, component_id), one row per row."""
    out = placed_rows(docs, id_col, text, similar)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: int = SIMILAR) -> DataFrame:
    """One document of each group, that with the smallest id, with the input's columns.

    Repeated rows of that id and text all stay, since they are one document; of rows without id one stays.
    """
    found = placed_rows(docs, id_col, text, similar).where("n > 0")
    leads = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node")) & (F.col("key") == F.col("first.key"))
    pair = [F.col("id").alias("_id"), F.col("key").alias("_key")]
    gone = cut_lineage(found.where(~leads).select(*pair).distinct())
    unnamed = cut_lineage(found.where(leads & F.col("id").isNull()).groupBy("key").count().where("count > 1").select(F.col("key").alias("_key")))
    keyed = docs.withColumn("_row_key", text_key(text))
    same = F.col("_row_key") == F.col("_key")
    left = keyed.join(small(gone), same & F.col(id_col).cast("bigint").eqNullSafe(F.col("_id")), "leftanti")
    if unnamed.isEmpty():
        return left.drop("_row_key")
    again = F.col(id_col).isNull()
    single = left.where(~again).unionAll(left.where(again).join(small(unnamed), same, "leftanti"))
    several = left.where(again).join(small(unnamed), same, "leftsemi").groupBy("_row_key").agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return single.drop("_row_key").unionAll(several.select("_row.*"))
