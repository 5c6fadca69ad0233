"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles; a text keeps the ``K`` smallest hashes
of its set.  Inverted lists of retained values propose pairs, the estimate from
the union of two sketches drops most of the unlike ones, and the Jaccard
similarity of the full sets decides.

Work stays linear in large groups.  Texts with equal sets are one class from the
start.  Retained values are looked up rarest first, and only as many of a text's
values as a pair at the threshold needs to meet (``_needed``), so a passage that
many texts share proposes nothing unless a text consists mostly of it.  Lists up
to ``CAP`` long propose all their pairs.  Texts on longer lists are looked up once
more by the rarest part of their full sets, which is exact; what still meets in
long lists is compared with ``PIVOTS`` members of ``LISTS`` of its lists, and after that only members
that are not yet connected to the list's main group meet all others.

Links are those of the full sets of 64-bit hashes of 5-word shingles.  A pair at
the threshold is missed with a chance below 1e-8 (the sketch bounds are binomial
tails); everything else is exact.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z taken as a-z; a text of
fewer than five words has its whole sequence as its one shingle; null, empty and
blank texts have none and link with nothing.  Rows that repeat an id share its
component.  A row with a null id links with nothing, has a null component and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as tx
from .common import components, stash

K, CAP, PIVOTS, LISTS, SHINGLE = 64, 48, 8, 4, 5
#: Pairs of full sets in one Arrow batch.
VERIFY_ROWS = 200
#: Hashes in the sets of the members and of the askers in one block of a long list; a larger set is a block's only one.
MEMBERS, OUTSIDERS = 1 << 20, 1 << 18
NUM, DEN = 75, 100
MISS = 1e-8
SKETCH = "struct<n:int,fp1:long,fp2:long,sketch:array<long>>"
FULL_SET = "struct<fp1:long,fp2:long,items:array<long>>"


def _tail(k: int, p: float, miss: float) -> int:
    """Largest c with P(Binomial(k, p) < c) <= miss."""
    total = 0.0
    for c in range(k + 1):
        total += comb(k, c) * p**c * (1 - p) ** (k - c)
        if total > miss:
            return c
    return k


def _needed() -> int:
    """Values that the sketches of a pair at the threshold share, but for a chance of MISS."""
    return max(1, _tail(K, NUM / DEN, MISS))


NEEDED = _needed()
#: Sets up to this size are whole in the sketch of every set that they can link with.
WHOLE = K * NUM // DEN


def _sets(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    for part in tx.chunks(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
        yield tx.shingle_sets(tx.words(tx.text_batch(part.column("t")), lower=True), SHINGLE)


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit fingerprints of each set."""
    one = np.array([np.add.reduce(tx.mix64(s)) if len(s) else 0 for s in sets], np.uint64)
    two = np.array([np.bitwise_xor.reduce(tx.mix64(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64)
    return one, two


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(tx.signed(flat.astype(np.uint64))))


@tx.tidied
def sketch(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Set size, fingerprints and bottom-K sketch of each text."""
    for texts in it:
        parts = []
        for sets in _sets(texts):
            one, two = _prints(sets)
            parts.append(pa.StructArray.from_arrays(
                [pa.array([len(s) for s in sets], pa.int32()), pa.array(tx.signed(one)), pa.array(tx.signed(two)), _lists([s[:K] for s in sets])],
                ["n", "fp1", "fp2", "sketch"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sketch", pa.list_(pa.int64()))]))


@tx.tidied
def full_set(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in it:
        parts = []
        for sets in _sets(texts):
            one, two = _prints(sets)
            parts.append(pa.StructArray.from_arrays([pa.array(tx.signed(one)), pa.array(tx.signed(two)), _lists(sets)], ["fp1", "fp2", "items"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("fp1", pa.int64()), ("fp2", pa.int64()), ("items", pa.list_(pa.int64()))]))


@tx.tidied
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets to those at the threshold: first by the sketches' union, then exactly."""
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        left, right = batch.column("sa"), batch.column("sb")
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        lv, rv = left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
            if min(len(x), len(y)) > WHOLE:
                union = np.unique(np.concatenate([x[:K], y[:K]]))[:K]
                top = union[-1]
                shared = np.searchsorted(x, top, "right") + np.searchsorted(y, top, "right") - len(union)
                if shared < NEEDED:
                    continue
            both = np.concatenate([x, y])
            both.sort()
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = DEN * same >= NUM * (len(both) - same)
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])


def _prefixes(values: DataFrame, prefix) -> DataFrame:
    """(v, rep, n, k) values of each text to those of its rarest ``prefix(n, k)`` that two texts hold,
    as (v, rep, n, u), u the number of its values that no other text holds. Those come first and are not moved."""
    counts = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    counts = stash(counts, "values")  # else the join keeps the sum's partitions and cannot split a hot value
    held = values.join(counts, "v")
    one = held.groupBy("rep", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("held"))
    length = F.greatest(F.lit(0), prefix(F.col("n"), F.col("k")) - (F.col("k") - F.size("held")))
    lists = one.select("rep", "n", (F.col("k") - F.size("held")).alias("u"), F.explode(F.slice("held", F.lit(1), length.cast("int"))).alias("x")).select(F.col("x.v").alias("v"), "rep", "n", "u")
    return stash(lists, "lists")


def _sizes(lists: DataFrame) -> DataFrame:
    return lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")


def _fit() -> Column:
    """What sizes allow: neither set is too small for the other, and the values that only one text holds
    at all, which cannot be shared, are few enough for a link."""
    sizes = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    return sizes & ((F.col("ua") + F.col("ub")) * (DEN + NUM) <= (F.col("na") + F.col("nb")) * (DEN - NUM))


def _pairs(x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs of full sets that share a list and may be linked."""
    x = x.select("v", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"))
    y = y.select(F.col("v").alias("w"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"))
    both = x.join(y, (F.col("v") == F.col("w")) & (F.col("a") != F.col("b")) & _fit())
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _small_pairs(lists: DataFrame, sizes: DataFrame) -> DataFrame:
    small = lists.join(sizes.where(F.col("m") <= CAP), "v").select("v", "rep", "n")
    x = small.select("v", F.col("rep").alias("a"), F.col("n").alias("na"))
    y = small.select(F.col("v").alias("w"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") * DEN >= F.col("nb") * NUM) & (F.col("nb") * DEN >= F.col("na") * NUM)
    return x.join(y, (F.col("v") == F.col("w")) & (F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")


def _sketch_prefix(n, k):
    return F.when(n <= WHOLE, n - F.ceil(n * NUM / DEN) + 1).otherwise(k - NEEDED + 1)


def _full_prefix(n, k):
    return n - F.ceil(n * NUM / DEN) + 1


def _long_links(full: DataFrame, sizes: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among the members of long lists: enough of them to connect all that are connected."""
    long = full.join(sizes.where(F.col("m") > CAP).select("v"), "v")
    order = Window.partitionBy("v").orderBy("h", "rep")
    pivots = long.withColumn("h", F.xxhash64("rep", "v")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= PIVOTS).select("v", "rep", "n", "u")
    few = long.groupBy("rep", "n", "u").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("v", "rep").alias("h"), "v"))), 1, LISTS).alias("l"))
    few = few.select("rep", "n", "u", F.explode("l").alias("x")).select(F.col("x.v").alias("v"), "rep", "n", "u")
    found = stash(_links(_pairs(pivots, few), sets), "links", VERIFY_ROWS)
    # Members outside a long list's main group meet all its other members, in blocks.
    groups = components(links.union(found))
    placed = long.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", "n", F.coalesce("component", "rep").alias("component"))
    main = placed.groupBy("v", "component").agg(F.count("*").alias("count"), F.sum("n").alias("items")).groupBy("v").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.max_by("items", F.struct("count", "component")).alias("inside"),
        F.sum("items").alias("items"), F.sum("count").alias("m"), F.max("count").alias("most")).where("m > most")
    open_ = placed.join(main, "v")
    open_ = stash(open_.select("v", "rep", "component", (F.col("component") != F.col("main")).alias("outside"),
        F.ceil(F.col("items") / MEMBERS).cast("int").alias("nm"), F.ceil((F.col("items") - F.col("inside")) / OUTSIDERS).cast("int").alias("no")), "open")
    own = open_.groupBy("rep").agg(F.array_sort(F.collect_list("v")).alias("lists"))
    full_sets = own.join(sets.select("rep", "items"), "rep")
    at = F.xxhash64("rep")
    members = open_.select("v", "rep", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("i"), F.pmod(at, F.col("nm")).cast("int").alias("j"))
    askers = open_.where("outside").select("v", "rep", "component", F.lit(True).alias("asks"), F.pmod(at, F.col("no")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("j"))
    blocks = members.union(askers).join(full_sets, "rep")
    more = blocks.groupBy("v", "i", "j").applyInArrow(_meet, "a long, b long").distinct()
    return found.union(stash(more, "links"))


def _meet(block: pa.Table) -> pa.Table:
    """Links between the askers and the members of a block of one list, of different groups: one for each
    asker and group. A pair that shares several lists is compared in the first."""
    block = block.combine_chunks()
    asks = np.array(block.column("asks").to_pylist(), bool)
    rep, group = block.column("rep").to_numpy(), block.column("component").to_numpy()
    items, lists = block.column("items").chunk(0), block.column("lists").chunk(0)
    at, values = items.offsets.to_numpy(), items.values.to_numpy()
    sizes = np.diff(at)
    own = [values[at[r] : at[r + 1]] for r in range(len(asks))]
    # Which of the lists before this one each row stands on.
    this = block.column("v")[0].as_py()
    lat, lvalues = lists.offsets.to_numpy(), lists.values.to_numpy()
    row = np.repeat(np.arange(len(asks)), np.diff(lat))
    flat = lvalues[lat[0] : lat[-1]]
    row, flat = row[flat < this], flat[flat < this]
    seen, code = np.unique(flat, return_inverse=True)
    members, askers = np.flatnonzero(~asks), np.flatnonzero(asks)
    place = np.full(len(asks), -1)
    place[members] = np.arange(len(members))
    theirs = place[row] >= 0
    stands, stands_on = place[row[theirs]], code[theirs]
    first, last = np.searchsorted(row, askers, "left"), np.searchsorted(row, askers, "right")
    everything = np.concatenate([own[r] for r in members]) if len(members) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(members)), sizes[members])
    by = np.argsort(everything, kind="stable")
    everything, owner = everything[by], owner[by]
    a, b = [], []
    for x, lo, hi in zip(askers, first, last):
        mark = np.zeros(len(seen), bool)
        mark[code[lo:hi]] = True
        earlier = np.bincount(stands[mark[stands_on]], minlength=len(members)) > 0
        near = ~earlier & (group[members] != group[x])
        if not near.any():
            continue
        lo, hi = np.searchsorted(everything, own[x], "left"), np.searchsorted(everything, own[x], "right")
        n = hi - lo
        hits = owner[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        shared = np.bincount(hits, minlength=len(members))
        linked = np.flatnonzero(near & (DEN * shared >= NUM * (sizes[members] + sizes[x] - shared)))
        for y in linked[np.unique(group[members[linked]], return_index=True)[1]]:
            a.append(min(rep[x], rep[members[y]]))
            b.append(max(rep[x], rep[members[y]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row for each: doc_id, n_shingles, component_id, kept, and the class's
    representative ``class_id`` (the smallest id with an equal set)."""
    base = docs.select("doc_id", F.arrow_udf(sketch, SKETCH)(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")
    base = stash(base, "sketches")
    classes = base.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("sketch").alias("sketch"))
    classes = stash(classes, "classes")
    # An id that stands on rows with different texts represents each of them: their classes are one component.
    values = classes.select(F.explode("sketch").alias("v"), "rep", "n", F.size("sketch").alias("k"))
    lists = _prefixes(values, _sketch_prefix)
    sizes = _sizes(lists)
    proposed = lists.join(sizes, "v").groupBy("rep").agg(F.max("m").alias("m"))
    wanted = classes.drop("sketch").join(proposed, "rep")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep")
    texts = texts.select("rep", "n", "m", F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), F.arrow_udf(full_set, FULL_SET)("text").alias("s"))
    sets = texts.where("f1 = s.fp1 AND f2 = s.fp2").select("rep", "n", "m", "s.items", "f1", "f2").dropDuplicates(["rep", "f1", "f2"])
    sets = stash(sets, "sets")
    links = stash(_links(_small_pairs(lists, sizes), sets), "links", VERIFY_ROWS)
    # Long lists: exact prefixes of the full sets of the texts on them.
    hot = sets.where(F.col("m") > CAP).select("rep", "n", "items")
    full = _prefixes(hot.select(F.explode("items").alias("v"), "rep", "n", F.size("items").alias("k")), _full_prefix)
    full_sizes = stash(_sizes(full), "sizes")
    links = links.union(stash(_links(_small_pairs(full, full_sizes), sets), "links", VERIFY_ROWS))
    if full_sizes.where(F.col("m") > CAP).limit(1).count():
        links = links.union(_long_links(full, full_sizes, links, sets))
    # An id on rows with different texts joins their classes.
    own = base.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("n", "fp1", "fp2", "rep"), ["n", "fp1", "fp2"])
    repeated = own.groupBy("doc_id").agg(F.min("fp1").alias("x"), F.max("fp1").alias("y")).where("x <> y").select("doc_id")
    joined = own.join(repeated, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(joined))
    member = own.select("doc_id", "n", F.col("rep").alias("class_id")).join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    linked = member.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "class_id").alias("component_id"), "class_id")
    alone = base.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    out = linked.union(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
