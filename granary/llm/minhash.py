"""Circulant MinHash near-duplicate detection with exact verification.

Every set of word shingles is mapped into a universe of 2**20 places by one random permutation
(sigma). A second permutation (pi), shifted circularly by 0, 1, 2, ..., gives every coordinate of the
signature, so the values of one element are a contiguous run of pi: two permutations stand for all
hash functions. Bands of coordinates nominate candidates, and links are confirmed on the full sets.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import kernels
from granary.llm.common import components, forget, free, keep, located, map_batches, small

UNIVERSE = 1 << 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def permutations(width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and a view whose row i holds pi at i, i + 1, ..., i + width - 1 (circularly)."""
    random = np.random.Generator(np.random.PCG64(seed))
    sigma = random.permutation(UNIVERSE).astype(np.int64)
    pi = random.permutation(UNIVERSE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[:width])), width)


def signature(elements: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Circulant MinHash signature of one set of 64-bit elements."""
    sigma, shifted = permutations(width, seed)
    at = sigma[(elements & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(width, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, shifted[at[i : i + 2048]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each signature (or for one) and band."""
    cells = signatures.reshape(*signatures.shape[:-1], bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), cells.shape[:-1])
    for j in range(rows):
        keys = kernels.mix(keys * _STEP + cells[..., j])
    return keys.view(np.int64)


def shingle_sets(texts: pa.Array, k: int):
    """The sorted distinct k-word shingles (64-bit hashes) of each text, lower-cased in ASCII.

    A text of fewer than k words has its whole sequence as its one shingle, a text without words none.
    """
    for _, _, data, offsets in kernels.chunks(texts):
        data = kernels.lowered(data)
        starts, ends, first = kernels.spans(data, offsets)
        words = kernels.span_hashes(data, starts, ends)
        windows, limits = kernels.window_hashes(words, first, k)
        for i in range(len(offsets) - 1):
            if limits[i] < limits[i + 1]:
                yield np.unique(windows[limits[i] : limits[i + 1]])
            elif first[i] < first[i + 1]:
                whole = np.uint64(first[i + 1] - first[i])
                for word in words[first[i] : first[i + 1]]:
                    whole = kernels.mix(np.array([whole * _STEP + word], np.uint64))[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _sums(elements: np.ndarray, seed: int) -> tuple[int, int]:
    """Sum and exclusive or of a set's mixed elements: with its size they stand for the set."""
    with np.errstate(over="ignore"):
        mixed = kernels.mix(elements + np.uint64(seed + 1))
        return int(mixed.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed).view(np.int64)) if len(mixed) else 0


def _signed(batch: pa.RecordBatch, k: int, bands: int, rows: int, seed: int):
    sizes, sums, others, keys = [], [], [], []
    for elements in shingle_sets(batch.column(1), k):
        one, other = _sums(elements, seed)
        sizes.append(len(elements))
        sums.append(one)
        others.append(other)
        keys.append(band_keys(signature(elements, bands * rows, seed), bands, rows) if len(elements) else np.zeros(0, np.int64))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, pa.int64()), _lists(keys)],
        ["id", "n", "set_sum", "set_xor", "keys"],
    )


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    limits = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values.view(np.int64), pa.int64()))


def _sets(batch: pa.RecordBatch, k: int, seed: int):
    """Batches of at most 2 million elements, so that no output batch grows with the texts."""
    ids, n, out, at = batch.column(0), 0, [], 0

    def rows():
        sums, others = zip(*(_sums(x, seed) for x in out), strict=True)
        return pa.RecordBatch.from_arrays([ids.slice(at, len(out)), pa.array(sums, pa.int64()), pa.array(others, pa.int64()), _lists(out)], ["doc", "set_sum", "set_xor", "elements"])

    for elements in shingle_sets(batch.column(1), k):
        out.append(elements)
        n += len(elements)
        if n > 2_000_000:
            yield rows()
            at, n, out = at + len(out), 0, []
    if out:
        yield rows()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a"))
    b = sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", common.alias("common"), (F.size("of_a") + F.size("of_b")).alias("both"))
    return joined.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("both") - F.col("common"))).select("a", "b")


def _prefixed(items: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``items`` (id, ...) with (i, element) of the rarest elements of which a similar set must share one."""
    elements = sets.join(items.select("id"), "id", "left_semi").select("id", F.explode("elements").alias("element"))
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    ordered = elements.join(often, "element").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("all"))  # one document's set
    length = F.size("all") - F.ceil(F.lit(percent) * F.size("all") / 100).cast("int") + 1
    return items.join(ordered, "id").select(*items.columns, F.posexplode(F.slice("all", F.lit(1), length)).alias("i", "x")).withColumn("element", F.col("x.element")).drop("x")


def _remaining(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may still be links: an item outside its bucket's largest component, and one of another component.

    They are met by an exact join of the sets: ``a`` and ``b`` share one of their rarest elements and
    neither their sizes nor the element's places rule the similarity out. Copies that differ by rare
    elements meet through those only, so a bucket of many near copies does not meet in full.
    """
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("items"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("items", "component")).alias("main"))
    mixed = mixed.where("parts > 1").select("key", F.col("main.component").alias("main"))
    rest = keep(labelled.join(mixed, "key"))
    stray = rest.where("component <> main")
    ranges = stray.groupBy("key").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    fits = (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    strays = stray.select("id").distinct().withColumn("stray", F.lit(True))
    items = rest.join(ranges, "key").where(fits).select("id", "n", "component").distinct().join(strays, "id", "left")
    prefixes = keep(_prefixed(keep(items), sets, percent))
    one = prefixes.where("stray").drop("stray")
    two = prefixes.select(F.col("id").alias("other"), F.col("n").alias("other_n"), F.col("component").alias("other_component"), F.col("i").alias("j"), "element")
    n, m = F.col("n"), F.col("other_n")
    similar = (F.col("component") != F.col("other_component")) & (100 * F.least(n, m) >= percent * F.greatest(n, m))
    similar &= (100 + percent) * F.least(n - F.col("i"), m - F.col("j")) >= percent * (n + m)
    pairs = one.join(two, (one["element"] == two["element"]) & similar)
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def link(members: DataFrame, sets: DataFrame, percent: int, rounds: int = 3, hubs: int = 4, given: DataFrame | None = None) -> DataFrame | None:
    """(node, component) of the items that share a band key and whose sets are similar enough.

    ``members`` (key, id, n): the buckets with more than one item. In each of a few rounds every
    bucket has one hub and an item of another component is compared with one hub only (after the first
    round with a few), so a bucket of m items costs about m comparisons. What is left (buckets with more
    than one component) goes through an exact join: no link is lost. ``given`` (a, b) are links from the start.
    Returns None if there is no link.
    """
    sized = 100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")
    edges, labels = given, None if given is None else components(given)

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("component", F.col("id"))
        of = labels.select(F.col("node").alias("id"), F.col("component").alias("of"))
        return members.join(of, "id", "left").select("key", "id", "n", F.coalesce("of", "id").alias("component"))

    def found(pairs: DataFrame) -> None:
        nonlocal edges, labels
        good = keep(verified(pairs, sets, percent))
        if not good.isEmpty():
            edges = good if edges is None else keep(edges.union(good))
            labels = components(edges)

    tested = None
    for turn in range(rounds):
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        now = labelled()
        hub = now.groupBy("key").agg(F.min(F.struct(order.alias("order"), "id", "n", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        hub = hub.where("low < high").select("key", F.col("hub.order").alias("order"), F.col("hub.id").alias("other"), F.col("hub.n").alias("other_n"), F.col("hub.component").alias("other_component"))
        near = now.join(hub, "key").where(F.col("component") != F.col("other_component")).where(sized)
        to = F.slice(F.array_sort(F.collect_set(F.struct("order", "other"))), 1, hubs if turn else 1)  # of one for each band at most
        pairs = keep(near.groupBy("id").agg(to.alias("to")).select(F.col("id").alias("a"), F.explode("to").alias("to")).select("a", F.col("to.other").alias("b")))
        if pairs.isEmpty():
            break
        found(pairs)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = pairs if tested is None else tested.union(pairs)
    pairs = _remaining(labelled(), sets, percent)
    pairs = keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        found(pairs)
    return labels


def near_duplicates(
    documents: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, seed: int = 11, rounds: int = 3
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (doc_id = component_id), a row for each row of documents.

    With 40 bands of 5 rows a pair at similarity 0.8 escapes with probability below 2e-7. Equal sets are
    merged before banding, so exact copies cost one row each. A text without words is linked with
    nothing; so is a row whose doc_id is null, which is kept. Rows that repeat a doc_id are one
    document: what is similar to one of its texts is linked with it. Extra columns are ignored.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    signed = keep(
        map_batches(source, partial(_signed, k=k, bands=bands, rows=rows, seed=seed), "id long, n long, set_sum long, set_xor long, keys array<long>")
    )
    present = signed.where("n > 0 AND id IS NOT NULL")
    content = ["n", "set_sum", "set_xor"]
    groups = present.groupBy(*content).agg(F.min(F.struct("id", "keys")).alias("first")).select(*content, F.col("first.id").alias("doc"), F.col("first.keys").alias("keys"))
    ends = present.groupBy("id").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in content for f in (F.min, F.max)])
    several = keep(ends.where(" OR ".join(f"{c}_min < {c}_max" for c in content)).select(F.col("id").alias("doc")))
    plain, given = several.isEmpty(), None
    if plain:
        groups = keep(groups.withColumn("id", F.col("doc")))
    else:  # ids with unequal texts: a node for each of their sets
        rank = F.row_number().over(Window.partitionBy("doc").orderBy(*content))
        groups = keep(groups.withColumn("id", F.when(rank == 1, F.col("doc")).otherwise(F.xxhash64(F.lit("set"), "doc", *content))))
        nodes = present.join(small(several), F.col("id") == F.col("doc"), "left_semi").select(F.col("id").alias("of"), *content).join(groups.select(*content, "id"), content)
        given = nodes.groupBy("of").agg(F.min("id").alias("a"), F.collect_set("id").alias("all")).select("a", F.explode("all").alias("b")).where("a <> b")  # of one document
        given = keep(given)
        given = None if given.isEmpty() else given
    buckets = groups.select(F.explode("keys").alias("key"), "id", "n")
    shared = keep(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("items")).where("items > 1").select("key"))
    members = keep(buckets.join(small(shared), "key"))
    wanted = keep(groups.join(members.select("id").distinct(), "id", "left_semi").select("doc", "id", "set_sum", "set_xor"))
    texts = source.join(small(keep(wanted.select("doc").distinct())), F.col("id") == F.col("doc"), "left_semi")
    sets = map_batches(texts, partial(_sets, k=k, seed=seed), "doc long, set_sum long, set_xor long, elements array<long>")
    sets = sets.withColumn("id", F.col("doc")) if plain else sets.join(small(wanted), ["doc", "set_sum", "set_xor"])
    sets = keep(sets.select("id", "elements").dropDuplicates(["id"]))
    labels = link(members, sets, percent, rounds, given=given)
    out = signed.select("id", *content).join(groups.select(*content, F.col("id").alias("node"), "doc"), content, "left")
    if labels is None:
        out = out.withColumn("component", F.col("doc"))
    else:
        firsts = labels.withColumnRenamed("node", "of")
        if not plain:  # nodes are not all doc_ids
            least = firsts.join(groups.select(F.col("id").alias("of"), "doc"), "of").groupBy("component").agg(F.min("doc").alias("least"))
            firsts = firsts.join(least, "component").select("of", F.col("least").alias("component"))
        out = out.join(firsts, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc", "id"))
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    forget(shared, members, wanted, sets)
    return out


def deduplicated(documents: DataFrame, **parameters) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns; one document of each group stays, that of the smallest doc_id.

    Each row goes by its own text. Where ids are null or repeated, such rows (but the first of each
    id) have a key made of their place in the files instead, larger than ids, so that rows with an id stay before them; what is not
    read from files is written first. Texts without words are linked with nothing and stay.
    """
    names = documents.columns
    dropped, file, row, key = free(documents, "__dropped", "__file", "__row", "__key")
    doc = F.col("doc_id").cast("long")
    odd = keep(documents.groupBy(doc.alias("odd")).agg(F.count(F.lit(1)).alias("rows")).where("odd IS NULL OR rows > 1"))
    if odd.isEmpty():
        table = documents.withColumn(key, doc)
    else:
        table = located(documents, file, row)
        if table is None:
            table = located(keep(documents), file, row)
        ids = small(odd).select("odd")
        of = F.col("doc_id").cast("long")
        firsts = table.select(of.alias("id"), F.struct(file, row).alias("place")).join(ids, F.col("id") == F.col("odd"), "left_semi")
        firsts = firsts.groupBy("id").agg(F.min("place").alias("first")).select(F.col("id").alias(f"{key}_id"), F.col("first").alias(f"{key}_first"))
        firsts = small(keep(firsts))
        made = F.xxhash64(file, row).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        other = of.isNull() | (F.col(f"{key}_first") != F.struct(file, row))
        table = table.join(firsts, of == F.col(f"{key}_id"), "left").withColumn(key, F.when(other, made).otherwise(of))
    decided = near_duplicates(table.select(F.col(key).alias("doc_id"), "text"), **parameters)
    gone = keep(decided.where(~F.col("kept")).select(F.col("doc_id").alias(dropped)).distinct())
    return table.join(small(gone), F.col(key) == F.col(dropped), "left_anti").select(*[F.col(f"`{c}`") for c in names])
