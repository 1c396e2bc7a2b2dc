"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Sketch (one narrow map): each text's distinct word shingles, a 128-bit id of that set, and a
   SuperMinHash signature folded into band keys.
2. Texts with equal sets form a class with one number (an aggregation with map-side combine); only
   classes go on, so groups of copies cost one row from here.
3. Classes that share a band key form a bucket; each is compared with the bucket's smallest
   number: first by signature, and where that does not rule a link out, on full shingle sets. Links are
   grouped by union-find inside tasks, then by rounds of large-star and small-star joins.
4. Buckets of three or more that still hold several groups are compared in full, between groups, in
   blocks bounded in members and in shingles: signatures leave the members that may have a link to
   another group, and the common shingles of those are counted by matrix products. A block returns members, or a
   spanning forest of its links, never its pairs. So no link between texts that share a band is lost.

With r rows a band and b bands, a pair of similarity s misses all bands with (1 - s**r)**b: at the
default 4 and 28 that is 1e-9 at 0.85 and 4e-7 at 0.8. Signatures rule a link out where they agree in
0.2 less than the similarity asked for, six of their standard deviations. Every reported link is
confirmed exactly. Ids whose texts are wanted again are broadcast up to a checked count, and joined by
shuffle beyond it.

Null or empty texts have no shingles and are linked with nothing. Each row is judged by its own text:
rows that repeat an id have their own components should their texts differ, and are kept or not one by
one. Rows without id keep to themselves. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut_lineage, give_back, output, written
from .words import mix, shingles, word_hashes

BATCH_BYTES = 1_000_000
ROWS, BANDS = 4, 28
#: Elements whose permutations are held at once; rows and about how many shingles of a block's side.
ELEMENTS, BLOCK_ROWS, BLOCK_SHINGLES = 200_000, 1024, 1_000_000
#: Ids that may be broadcast (8 bytes each), and how far below the similarity signatures must lie to rule a link out.
BROADCAST_IDS, MARGIN = 4_000_000, 0.2
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def super_minhash(elements: np.ndarray, ends: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (texts x slots): level << 32 | random part of the smallest rank.

    Every element draws, level by level, a random part and the next place of its own random
    permutation of the slots (a lazy Fisher-Yates shuffle). A value of a level is below all values of
    later levels, so a text stops at the level that fills its last slot.
    """
    texts = len(ends) - 1
    best = np.full(texts * slots, _NONE, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(ends))
    for at in range(0, len(elements), ELEMENTS):
        element, doc = elements[at : at + ELEMENTS], owner[at : at + ELEMENTS]
        places = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
        row = np.arange(len(element))
        for level in range(slots):
            drawn = mix(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            swap = level + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
            slot = places[row, swap].astype(np.int64)
            places[row, swap] = places[row, level]
            np.minimum.at(best, doc * slots + slot, (drawn >> np.uint64(32)) | np.uint64(level << 32))
            open_docs = best.reshape(texts, slots).max(axis=1) >= np.uint64((level + 1) << 32)
            stay = open_docs[doc]
            if not stay.any():
                break
            if stay.mean() < 0.7:
                element, doc, row = element[stay], doc[stay], row[stay]
    return best.reshape(texts, slots)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(texts x bands) keys; the band's number is part of its key."""
    bands = signatures.shape[1] // rows
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k : bands * rows : rows])
    return keys


def _set_ids(element: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Two 64-bit ids of each set; null for an empty one."""
    ids = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(element ^ np.uint64(seed)), dtype=np.uint64)])
        ids.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64), mask=np.diff(ends) == 0))
    return ids


def _sketch(rows: DataFrame, size: int, per_band: int, bands: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("slots", pa.binary())])

    def sketched(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            element, ends = shingles(*word_hashes(batch.column("text")), size)
            n = np.diff(ends)
            signatures = super_minhash(element, ends, per_band * bands)
            keys = band_keys(signatures, per_band)
            slots = (mix(signatures) & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
            yield output(schema, [batch.column("key"), batch.column("mark"), n, *_set_ids(element, ends), lists, [row.tobytes() for row in slots]])
        give_back()

    return rows.withColumn("mark", F.xxhash64("text")).mapInArrow(sketched, "key long, mark long, n_shingles long, set_a long, set_b long, bands array<long>, slots binary")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    schema = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def listed(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            element, ends = shingles(*word_hashes(batch.column("text")), size)
            yield output(schema, [*_set_ids(element, ends), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(element.view(np.int64)))])
        give_back()

    return rows.mapInArrow(listed, "set_a long, set_b long, elements array<long>")


def _sets_of(rows: DataFrame, classes: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, elements) of the classes (want), one row each."""
    named = written(classes.select("node", "key", "set_a", "set_b").join(nodes.distinct(), F.col("node") == F.col("want"), "left_semi"), "wanted")
    texts = _texts_of(rows, named.select(F.col("key").alias("want")).distinct())
    found = _sets(texts, size).where("set_a IS NOT NULL").groupBy("set_a", "set_b").agg(F.any_value("elements").alias("elements"))
    return written(found.join(named.select("node", "set_a", "set_b"), ["set_a", "set_b"]).select("node", "elements"), "sets")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("a"), F.col("elements").alias("xs")), sets.select(F.col("node").alias("b"), F.col("elements").alias("ys"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirmed(batches):
        for batch in batches:
            found = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("xs"), batch.column("ys"), strict=True):
                if _linked(x.values.to_numpy(), y.values.to_numpy(), num, den):
                    found.append((a, b))
            if found:
                yield output(schema, [list(c) for c in zip(*found, strict=True)])
        give_back()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "xs", "ys").mapInArrow(confirmed, "a long, b long")


def _slots(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _likely(pairs: DataFrame, slots: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least so large a share."""
    left, right = slots.select(F.col("node").alias("a"), F.col("slots").alias("sa")), slots.select(F.col("node").alias("b"), F.col("slots").alias("sb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def kept(batches):
        for batch in batches:
            if batch.num_rows:
                keep = (_slots(batch.column("sa")) == _slots(batch.column("sb"))).mean(axis=1) >= least
                yield output(schema, [batch.column("a"), batch.column("b")]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(kept, "a long, b long")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (key, text) whose key is wanted (want, distinct)."""
    few = wanted.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(wanted) if few else wanted, rows["key"] == wanted["want"], "left_semi")


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node it is connected with."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def forest(batches):
        found = Forest()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                found.join(a, b)
        nodes = list(found.parent)
        for at in range(0, len(nodes), 50_000):
            own = nodes[at : at + 50_000]
            yield output(schema, [own, [found.root(x) for x in own]])

    edges = cut_lineage(links.mapInArrow(forest, "u long, v long").distinct())
    mark = None
    while True:  # until a round changes nothing, a number of rounds that grows with the logarithm of the nodes
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        edges = cut_lineage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def block_links(nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different groups."""
    if len(nodes) < 2 or (groups == groups[0]).all():
        return []
    sizes = np.asarray([len(s) for s in sets], np.int64)
    names, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # shingles of one text are common to none
    column = np.where(shared, np.cumsum(shared) - 1, -1)[number]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    own, members = np.unique(groups, return_counts=True)
    rest = np.flatnonzero(groups != own[members.argmax()])  # every link between groups has an end here
    common = np.zeros((len(rest), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        here = (column >= at) & (column < at + 4096)
        x = np.zeros((len(sets), 4096), np.float32)
        x[row[here], column[here] - at] = 1
        common += x[rest] @ x.T
    similar = den * common >= num * (sizes[rest, None] + sizes[None, :] - common)
    similar &= groups[rest, None] != groups[None, :]
    found, out = Forest(), []
    for i, j in zip(*np.nonzero(similar), strict=True):
        if found.join(int(groups[rest[i]]), int(groups[j])):
            out.append((int(nodes[rest[i]]), int(nodes[j])))
    return out


def _blocks(rows: DataFrame, *carried: str) -> DataFrame:
    """Rows (bucket, n, total, node, component, carried) dealt to pairs of chunks (i, j) of their bucket; total: its shingles."""
    chunks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    split = rows.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return split.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", *carried)


def near_members(groups: np.ndarray, slots: np.ndarray, least: float) -> np.ndarray:
    """Which rows have a row of another group whose signature agrees in at least so large a share."""
    near = np.zeros(len(groups), bool)
    own, members = np.unique(groups, return_counts=True)
    for i in np.flatnonzero(groups != own[members.argmax()]):
        partner = ((slots == slots[i]).mean(axis=1) >= least) & (groups != groups[i])
        if partner.any():
            near |= partner
            near[i] = True
    return near


def _open_members(rows: DataFrame, least: float) -> DataFrame:
    """(bucket, node) of rows (bucket, n, node, component, slots) that may be linked with another component of their bucket."""

    def opened(table: pa.Table) -> pa.Table:
        keep = near_members(table.column("component").to_numpy(), _slots(table.column("slots")), least)
        return table.select(["bucket", "node"]).filter(pa.array(keep))

    return _blocks(rows.withColumn("total", F.lit(0)), "slots").groupBy("bucket", "i", "j").applyInArrow(lambda t: opened(t), "bucket long, node long").distinct()


def _between_groups(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links of rows (bucket, n, total, node, component, elements) between components of a bucket, in blocks."""

    def linked(table: pa.Table) -> pa.Table:
        sets = [s.values.to_numpy() for s in table.column("elements")]
        found = block_links(table.column("node").to_numpy(), table.column("component").to_numpy(), sets, num, den)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return _blocks(rows, "elements").groupBy("bucket", "i", "j").applyInArrow(lambda t: linked(t), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", per_band: int = ROWS, bands: int = BANDS, marked: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row; texts are linked if den * common >= num * union of their shingles.

    marked: also ``mark``, a 64-bit hash of the row's text, and ``group``, a number of its component (null without shingles).
    """
    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    sketch = written(_sketch(rows, shingle, per_band, bands), "sketch")
    grouped = sketch.where("n_shingles > 0 AND key IS NOT NULL").groupBy("set_a", "set_b").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("slots").alias("slots"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("held")).where("n > 1")
    members = written(members.join(buckets, "bucket").select("bucket", "node", "lead", "n", "held"), "bucket-members")
    least = num / den - MARGIN
    slots = classes.select("node", "slots")
    pairs = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(_likely(pairs, slots, least), "star-pairs")
    links = written(_verified(pairs, _sets_of(rows, classes, pairs.select(F.col("a").alias("want")).union(pairs.select("b")), shingle), num, den), "links")
    found = components(links)

    # buckets of two are settled; of the others, those that hold several groups are left, each set of members once
    grouped = written(members.where("n > 2").join(found, "node", "left").select("bucket", "n", "held", "node", F.coalesce("component", "node").alias("component")), "bucket-groups")
    left = grouped.groupBy("bucket", "held").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").groupBy("held").agg(F.min("bucket").alias("bucket")).select("bucket")
    opened = written(_open_members(grouped.join(left, "bucket").join(slots, "node"), least), "open-members")
    if not opened.isEmpty():
        sizes = opened.join(classes.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
        open_rows = grouped.drop("n", "held").join(opened, ["bucket", "node"], "left_semi").join(sizes, "bucket")
        sets = _sets_of(rows, classes, opened.select(F.col("node").alias("want")), shingle)
        more = written(_between_groups(open_rows.join(sets, "node").select("bucket", "n", "total", "node", "component", "elements"), num, den), "more-links")
        if not more.isEmpty():
            found = components(links.union(more))

    # a component is named by the smallest id of its classes
    placed = classes.select("set_a", "set_b", "key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = placed.groupBy("component").agg(F.min("key").alias("name"))
    placed = placed.select("set_a", "set_b", "component").join(named, "component")
    out = sketch.select("key", "mark", "n_shingles", "set_a", "set_b").join(placed, ["set_a", "set_b"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("name", "key"))
    return out.select(F.col("key").alias(id_col), "n_shingles", component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), *(["mark", F.col("component").alias("group")] if marked else []))


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns: that of the smallest id, and should several rows of the group have it, the first by all columns.

    Of rows without words that repeat an id, one stays, too.
    """
    found = written(near_duplicates(docs, shingle, num, den, id_col, text_col, marked=True), "near-duplicates")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no name clashes with a helper's
    own = F.col(f"c{names.index(id_col)}")
    same = (own == F.col("id")) & (F.xxhash64(F.col(f"c{names.index(text_col)}").cast("string")) == F.col("mark"))
    named = found.select(F.col(id_col).alias("id"), "mark", "group", "kept")
    stay = plain.join(named.where("NOT kept").select("id", "mark").distinct(), same, "left_anti")
    # only ids that repeat need a choice; all other rows pass without a shuffle of their own
    kept = named.where("kept AND id IS NOT NULL").drop("kept")
    twice = kept.groupBy("id").count().where("count > 1").select("id")
    if not twice.isEmpty():
        once = stay.join(twice, own == F.col("id"), "left_anti")
        several = plain.join(kept.join(twice, "id", "left_semi").distinct(), same)
        chosen = several.groupBy("id", "group").agg(F.min(F.struct(*plain.columns)).alias("row"))
        stay = once.unionByName(chosen.select("row.*"))
    return stay.toDF(*names)
