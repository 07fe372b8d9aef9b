"""Near-duplicate groups by DartMinHash signatures and banded joining, every link verified exactly.

Darts are thrown by hashing: each element (a shingle) has a strip of the plane for each range of its weight, [0, 1),
[1, 2), [2, 4) and so on, and a strip receives darts at the times of a Poisson process whose rate is its width, all
drawn from hashes of the element alone.  A dart counts for a text if it falls below the element's weight; it belongs to
one of the signature's coordinates, and the earliest dart of each coordinate stays.  Two texts agree in a coordinate
with the probability of their weighted Jaccard similarity.  Throwing stops at the time by which all coordinates should
have darts, so it costs about k log k darts and one look at each element, whatever the weights.

Texts with equal element sets form classes first, and one of each class goes on.  In every bucket of a band, members are
linked to the bucket's leader, and groups are closed.  Where many members stand outside of their bucket's largest group,
they are compared with another leader.  In the end those still outside are compared with all members of their bucket that
belong to other groups, first by sketches of two bits a coordinate, then exactly.  So no group of near copies
is ever paired out, and no link between groups is missed but by the chance that the docstrings name.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored, worker_cache
from .decontamination import words_of

BANDS, ROWS = 30, 5
#: Coordinates of a signature: the first BANDS * ROWS make the bands, two bits of each make the sketch.
COORDINATES = 512
#: Members outside of a bucket's largest group from which on another leader is tried before all are compared.
CROWD = 4
#: Keys up to this number are sent to all tasks; more are joined by shuffle.
MOST_BROADCAST = 300_000
#: Rows of one key that a join puts into one task; the rows of larger keys are dealt to several.
PORTION = 1000
#: Copies of the mapped side where a mapping is too large to be sent to all tasks.
SALTS = 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs only give equal outputs, and all bits look random."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """Hashes of all runs of `size` words, in text order; a shorter text is one run, an empty one none."""
    h = np.fromiter(map(worker_cache("near_dup", _Hashes).__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out + h[i : len(out) + i] + _A)
    return out


def elements(text: str | None, size: int, weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text and their weights: 1 each for weight='set', occurrences for 'count'."""
    found, n = np.unique(shingles(words_of(text), size), return_counts=True)
    return found, n.astype(np.float64) if weight == "count" else np.ones(len(found))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """(texts x k): the time of the earliest dart of each coordinate, which tells darts apart; inf for empty texts."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(e) for e, _ in sets])
    element = np.concatenate([e for e, _ in sets] or [np.zeros(0, np.uint64)])
    weight = np.concatenate([w for _, w in sets] or [np.zeros(0)])
    total = np.bincount(owner, weight, minlength=n)
    # One unit for each strip that a weight reaches into.
    strips = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64) + 1
    unit = np.repeat(np.arange(len(element)), strips)
    strip = np.arange(len(unit)) - np.repeat(np.cumsum(strips) - strips, strips)
    owner, weight = owner[unit], weight[unit]
    width = np.where(strip == 0, 1.0, 2.0 ** np.maximum(strip - 1, 0))
    low = np.where(strip == 0, 0.0, width)
    seed = mix(element[unit] + strip.astype(np.uint64) * _A)
    limit = k * (np.log(k) + 2) / np.maximum(total, 1e-9)
    out = np.full(n * k, np.inf)

    def arrival(s, m):
        h = mix(s + m.astype(np.uint64) * _C)
        return h, -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)

    turn = np.zeros(len(unit), np.int64)
    dart, wait = arrival(seed, turn)
    at = wait / width
    live = np.nonzero(at <= limit[owner])[0]
    while True:
        while len(live):
            h = mix(dart[live] ^ _A)
            place = low[live] + width[live] * ((h >> np.uint64(40)).astype(np.float64) / 2.0**24)
            below = place < weight[live]
            cell = owner[live] * k + ((h & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out, cell[below], at[live][below])
            turn[live] += 1
            dart[live], wait = arrival(seed[live], turn[live])
            at[live] += wait / width[live]
            live = live[at[live] <= limit[owner[live]]]
        short = np.isinf(out.reshape(n, k)).any(1) & (total > 0)
        if not short.any():
            return out.reshape(n, k)
        limit[short] *= 2
        live = np.nonzero(short[owner] & (at <= limit[owner]))[0]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts x bands) of bucket keys, the band's number among what is hashed."""
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    key = np.zeros((len(signature), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = mix(key + bits[:, :, i] + _A)
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """(texts x k / 32) of 64-bit words: the first half holds one bit of every coordinate's dart, the second another."""
    h = mix(signature.view(np.uint64))
    planes = [np.packbits(((h >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for b in (0, 1)]
    return np.concatenate(planes, axis=1)


def least_agreement(least: float, k: int = COORDINATES) -> int:
    """Sketch coordinates in which a pair of similarity `least` agrees at least, but for one such pair in 100,000."""
    p = least + (1 - least) / 4
    return int(k * p - 4.3 * np.sqrt(k * p * (1 - p)))


def agreement(x: str, y: str, k: int = COORDINATES) -> Column:
    """Coordinates in which both bits of two sketches agree; columns x_s0, x_s1 .. and y_s0 .."""
    n = k // 64
    differ = [F.col(f"{x}_s{i}").bitwiseXOR(F.col(f"{y}_s{i}")).bitwiseOR(F.col(f"{x}_s{n + i}").bitwiseXOR(F.col(f"{y}_s{n + i}"))) for i in range(n)]
    return F.lit(k) - functools.reduce(lambda a, b: a + b, [F.bit_count(d) for d in differ])


def sign(docs: DataFrame, size: int, weight: str, bands: int, rows: int) -> DataFrame:
    """doc_id, n (elements), d1 and d2 (hashes of the element set), keys (of the bands; none for empty texts), sketch."""

    def make(batch):
        sets = [elements(t, size, weight) for t in batch.column("text").to_pylist()]
        signature = signatures(sets, COORDINATES)
        keys, sketch = band_keys(np.ascontiguousarray(signature[:, : bands * rows]), bands, rows), sketches(signature)
        d1 = [int(mix(e + w.astype(np.uint64) * _A).sum().view(np.int64)) if len(e) else 0 for e, w in sets]
        d2 = [int(mix(e * _B + w.astype(np.uint64)).sum().view(np.int64)) if len(e) else 0 for e, w in sets]
        return {"doc_id": batch.column("doc_id"), "n": [len(e) for e, _ in sets], "d1": d1, "d2": d2, "keys": [list(k) if len(e) else [] for k, (e, _) in zip(keys, sets, strict=True)], "sketch": list(sketch)}

    return mapped(docs, "text", make, "doc_id long,n long,d1 long,d2 long,keys array<long>,sketch array<long>", most=1_000_000)


def among(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Rows of df whose key is among ids (how: left_semi) or not (left_anti); few ids are sent to all tasks."""
    return df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, column, how)


def mapped_by(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """df left joined to mapping (one row for each value of column); values may be as frequent as they like in df."""
    if mapping.count() <= MOST_BROADCAST:
        return df.join(F.broadcast(mapping), column, "left")
    salted = mapping.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [column, "_salt"], "left").drop("_salt")


def verified(pairs: DataFrame, docs: DataFrame, size: int, weight: str, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity over whole texts is `least` or more."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "neardup-ids")

    def make(batch):
        sets = [elements(t, size, weight) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "elements": [e.tobytes() for e, _ in sets], "weights": [w.astype(np.float32).tobytes() if weight == "count" else b"" for _, w in sets]}

    sets = mapped(among(docs, ids, "doc_id", "left_semi"), "text", make, "doc_id long,elements binary,weights binary")
    sets = stored(sets.dropDuplicates(["doc_id"]), "neardup-sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"), F.col("weights").alias("wa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"), F.col("weights").alias("wb"))
    # A leader of many pairs is copied for each PORTION of them, so its pairs and its elements spread over tasks.
    leading = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).alias("portions")).where("portions > 1"), "neardup-leading")
    portions = F.coalesce("portions", F.lit(1))
    pairs = mapped_by(pairs, leading, "a").select("a", "b", F.pmod(F.xxhash64("b"), portions).alias("portion"))
    one = mapped_by(one, leading, "a").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1))).drop("portions")

    def alike(batch):
        keep = []
        for ea, wa, eb, wb in zip(*(batch.column(c).to_pylist() for c in ("ea", "wa", "eb", "wb")), strict=True):
            x, y = np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = y[at] == x
            if wa:
                u, v = np.frombuffer(wa, np.float32).astype(float), np.frombuffer(wb, np.float32).astype(float)
                common, whole = np.minimum(u[both], v[at[both]]).sum(), u.sum() + v.sum()
            else:
                common, whole = int(both.sum()), len(x) + len(y)
            keep.append(common >= least * (whole - common) - 1e-9)
        a, b = (batch.column(c).to_numpy(zero_copy_only=False)[np.array(keep, bool)] for c in ("a", "b"))
        return {"a": a, "b": b}

    return mapped(pairs.join(one, ["a", "portion"]).join(two, "b"), "ea", alike, "a long,b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component; by least neighbours and pointer jumping."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to"))).distinct(), "neardup-edges")
    label = both.groupBy("node").agg(F.least("node", F.min("to")).alias("label"))
    while True:
        seen = both.join(label.select(F.col("node").alias("to"), "label"), "to").select("node", "label").unionByName(label)
        least = stored(seen.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("high")), "neardup-least")
        # A label's own label, once for each label, however many nodes bear it.
        moving = least.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        moving = stored(moving.join(least.select("label").distinct(), "label", "left_semi"), "neardup-moving")
        jump = mapped_by(least, moving, "label")
        label = stored(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label"), (F.col("label") != F.col("high")).alias("moved")), "neardup-labels")
        # A component is done once all labels that meet at each of its nodes are equal.
        if not label.where("moved").limit(1).count():
            return label.drop("moved")
        label = label.drop("moved")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """node, label after more links: only the groups that links tie are put together anew."""
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    ties = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    ties = stored(ties, "neardup-ties")
    groups = components(ties.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("to"))
    every = label.unionByName(ties.select(F.col("a").alias("node"), F.col("la").alias("label"))).unionByName(ties.select(F.col("b").alias("node"), F.col("lb").alias("label"))).distinct()
    return stored(mapped_by(every, stored(groups.where("label <> to"), "neardup-groups"), "label").select("node", F.coalesce("to", "label").alias("label")), "neardup-labels")


def _met_before() -> Column:
    """Whether x and y share a bucket of a band before this row's."""
    both = F.arrays_zip(F.col("x_keys").alias("a"), F.col("y_keys").alias("b"))
    first = F.array_position(F.transform(both, lambda z: (z["a"] == z["b"]).cast("int")), 1).cast("int")
    return F.element_at("x_keys", first) != F.shiftrightunsigned("bucket", 33).cast("int")


def _named(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members with their group's label; each bucket's largest group, members, and members outside of that group."""
    named = members.select("bucket", "doc_id", "n").join(label.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = stored(named, "neardup-named")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    modes = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("members"))
    return named, stored(modes.select("bucket", F.col("most.label").alias("mode"), "members", (F.col("members") - F.col("most.size")).alias("apart")), "neardup-modes")


def grouped_rows(rows_: DataFrame, least: float, size: int, weight: str, bands: int, rows: int) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), n of every row; rows of one doc_id have equal texts."""
    signed = stored(sign(rows_, size, weight, bands, rows), "neardup-signed")
    full = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "neardup-classes")
    buckets = full.join(classes.drop("size").withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n", "doc_id"]).select("doc_id", "n", F.explode("keys").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("lead"), F.max("doc_id").alias("last")).where("lead.doc_id < last")
    members = stored(buckets.join(leaders.select("bucket", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("lead_n")), "bucket"), "neardup-members")
    traits = [F.transform("keys", lambda k: F.shiftrightunsigned(k, 33).cast("int")).alias("keys"), *[F.col("sketch")[i].alias(f"s{i}") for i in range(COORDINATES // 32)]]
    traits = stored(full.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *traits).dropDuplicates(["doc_id"]), "neardup-traits")
    fits = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-9 if weight == "set" else F.lit(True)
    first = members.where((F.col("doc_id") != F.col("lead")) & fits(F.col("n"), F.col("lead_n"))).select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = stored(verified(stored(first, "neardup-pairs"), rows_, size, weight, least), "neardup-links")
    label = components(edges)
    columns = ("doc_id", "label", "n", "keys", *[f"s{i}" for i in range(COORDINATES // 32)])
    side = lambda df, x: df.join(traits, "doc_id").select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in columns])
    # Sketches tell most pairs below the limit; a pair that meets in several buckets counts in its first one.
    near = (F.col("x_label") != F.col("y_label")) & fits(F.col("x_n"), F.col("y_n")) & (agreement("x", "y") >= least_agreement(least))

    def compare(label: DataFrame, one: DataFrame, two: DataFrame, condition: Column) -> DataFrame:
        # A bucket's first side is dealt to portions, each of which meets a copy of the second side.
        large = stored(one.groupBy("bucket").agg(F.ceil(F.count("*") / PORTION).alias("portions")).where("portions > 1"), "neardup-large")
        portions = F.coalesce("portions", F.lit(1))
        left = mapped_by(side(one, "x"), large, "bucket").withColumn("portion", F.pmod(F.xxhash64("x_doc_id"), portions)).drop("portions")
        right = mapped_by(side(two, "y"), large, "bucket").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1))).drop("portions")
        across = left.join(right, ["bucket", "portion"]).where(condition)
        pairs = across.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()
        links = stored(verified(stored(pairs, "neardup-pairs"), rows_, size, weight, least), "neardup-links")
        return merged(label, links) if links.limit(1).count() else label

    named, modes = _named(members, label)
    crowded = modes.where(F.col("apart") > CROWD)
    if crowded.limit(1).count():  # another leader first: most members of such a bucket find their group so
        there = named.join(crowded.select("bucket"), "bucket", "left_semi")
        pick = F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("h"), "doc_id", "label", "n")).alias("pick")
        leads = there.groupBy("bucket").agg(pick).select("bucket", "pick.doc_id", "pick.label", "pick.n")
        label = compare(label, leads, there, near)
        still = modes.where("apart > 0").select("bucket")
        named, modes = _named(members.join(still, "bucket", "left_semi"), label)
    # What is outside of its bucket's largest group, against all others there.
    parted = named.join(modes.where("apart > 0").select("bucket", "mode"), "bucket")
    label = compare(label, parted.where("label <> mode"), parted, near & ~_met_before())
    grouped = classes.join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select("d1", "d2", "n", "size", F.coalesce("label", "rep").alias("class_id"))
    # Classes of a hundred-thousandth of all rows or more, which are a hundred thousand at most, go to every task; so no
    # class is a hot key of the join of the others.  Texts without words have no class.
    frequent = F.col("size") >= max(PORTION, signed.count() // 100_000)
    own, on = signed.select("doc_id", "n", "d1", "d2"), ["d1", "d2", "n"]
    found = own.where("n > 0").join(F.broadcast(grouped.where(frequent).drop("size").withColumnRenamed("class_id", "large")), on, "left")
    rest = found.where("large IS NULL").drop("large").join(grouped.where(~frequent).drop("size"), on, "left").select("doc_id", "n", "class_id")
    found = rest.unionByName(found.where("large IS NOT NULL").select("doc_id", "n", F.col("large").alias("class_id"))).unionByName(own.where("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("class_id")))
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), "n")


def _parted(rows_: DataFrame) -> DataFrame | None:
    """doc_id, of keys that rows with different texts share; None if there are none."""
    texts = rows_.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    found = stored(texts.where("a <> b").select("doc_id"), "neardup-parted")
    return found if found.limit(1).count() else None


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, weight: str = "set", bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id (the least key of its group), n_shingles of every row.

    Words are runs of ASCII digits and letters, lower-cased, and other bytes over 7F; elements are runs of `size` words.
    Texts without words, null ones among them, are groups of their own; a null key has a null class.  Rows of one key are in
    one group, whatever their texts, each of which has its own links; n_shingles is that of a row's own text.  A pair
    of similarity s shares a bucket with probability 1 - (1 - s^rows)^bands, over 0.99999 for 0.8 and the defaults.
    """
    rows_ = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parted = _parted(rows_)
    if parted is None:
        return grouped_rows(rows_, least, size, weight, bands, rows).select(F.col("doc_id").alias(key), "class_id", F.col("n").alias("n_shingles"))
    # Texts of a key with several go by a number of their own; in the end their groups are tied by the key.
    few = parted.count() <= MOST_BROADCAST
    marked = rows_.join((F.broadcast(parted) if few else parted).withColumn("parted", F.lit(True)), "doc_id", "left")
    own = F.when(F.col("parted"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))
    named = stored(marked.where("parted").select(own.alias("node"), F.col("doc_id").alias("name")).distinct(), "neardup-named-texts")
    found = stored(grouped_rows(marked.select(own.alias("doc_id"), "text"), least, size, weight, bands, rows), "neardup-found")
    nodes = found.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "class_id").distinct()
    of = stored(nodes.join(F.broadcast(named) if named.count() <= MOST_BROADCAST else named, "node", "left").select("node", "class_id", F.coalesce("name", "node").alias("name"), F.col("name").isNotNull().alias("parted")), "neardup-nodes")
    ties = of.where("parted").groupBy("name").agg(F.min("class_id").alias("a"), F.collect_set("class_id").alias("bs")).select("a", F.explode("bs").alias("b")).where("a <> b")
    label = components(stored(ties, "neardup-ties")).select(F.col("node").alias("class_id"), "label")
    tied = of.join(label, "class_id", "left").withColumn("group", F.coalesce("label", "class_id"))
    least_name = tied.groupBy("group").agg(F.min("name").alias("least"))
    names = stored(tied.join(least_name, "group").select(F.col("node").alias("doc_id"), "name", F.col("least").alias("class_id")), "neardup-names")
    return found.drop("class_id").join(names, "doc_id", "left").select(F.col("name").alias(key), "class_id", F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose key is the least of its group: same columns, texts whole.

    Rows of a null key stay.  Of several rows of such a key one stays, that with the least SHA-256 of its text.
    """
    found = stored(near_duplicates(docs, key=key, text=text, **options).select(F.col(key).alias(key), "class_id"), "neardup-groups")
    dropped = stored(found.where(F.col(key) != F.col("class_id")).select(key).distinct(), "neardup-dropped")
    kept = among(docs, dropped, key, "left_anti").select(docs.columns)
    repeated = stored(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "neardup-repeated")
    if not repeated.limit(1).count():
        return kept
    several = among(kept, repeated, key, "left_semi")
    one = several.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.sha2(text, 256), F.lit(""))).alias("_row")).select("_row.*")
    return among(kept, repeated, key, "left_anti").unionByName(one)
