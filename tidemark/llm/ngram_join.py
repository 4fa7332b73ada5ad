"""Near duplicates by the Jaccard similarity of word n-gram sets, as a blocked sparse product.

A document is a row of the sparse incidence matrix of documents by n-grams. Two documents link
when the product of their rows, the size of the intersection, reaches the threshold share of the
union. All links are found without multiplying the whole matrix:

1. A first pass sums, per document, how many of its n-grams any other document holds. This is an
   upper bound of its overlap with every single one, so documents below their own size-derived
   bound leave. Long documents are summed over a fixed part of the columns (the n-grams whose hash
   lies in the *zone*), where a linked pair can differ by no more than it may differ as a whole.
2. Rows of the documents that are left are collapsed to distinct sets and multiplied in blocks. The
   columns are the rarest n-grams of each row, as many as a linked pair can differ by, plus one, so
   a linked pair meets in at least one. In the first blocks one row per column, its hub, meets the
   others; pairs outside the size bound are discarded, the rest get their exact overlap.
   Members of one component need no further proof. The columns whose rows still lie in different
   components go into the last product: the rows that meet one hub are cut into blocks, a task
   multiplies two blocks tile by tile and returns the links that join components. It is exact:
   every pair that could link either has been multiplied or is connected already.

Nothing is capped. A column of half the corpus costs one entry per batch of documents in the first
pass, and one pair per member in a hub block. No pair leaves a task unless it links.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.common import keep, modest_batches, scratch, slices
from tidemark.llm.components import components

#: Rows of at most this many n-grams are summed over all columns.
SMALL_SET = 200
HUB_BLOCKS = 1
#: Rows of a block of the last product, and what its tiles hold at most.
BLOCK_ROWS, TILE_ROWS, TILE_GRAMS = 1024, 256, 1 << 16

_SETS = "doc_id long, n int, hi long, lo long, z int, own_all int, own_zone int, once array<long>, twice array<long>"


#: The zone's share of all columns, as a multiple of the share in which a linked pair may differ.
ZONE = 1.75


def zone_limit(percent: int) -> int:
    """Hashes below it are in the zone."""
    return int(min(1.0, ZONE * (100 - percent) / 100) * 2.0 ** 64)


def _in_zone(values: np.ndarray, limit: int) -> np.ndarray:
    return values < np.uint64(limit) if limit < 2 ** 64 else np.ones(len(values), bool)


def incidence(texts: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of a batch: the distinct n-grams of every text, sorted."""
    doc, hashes = [], []
    for d, h, _, _ in words.words(texts):
        doc.append(d)
        hashes.append(h)
    if not doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return words.unique_per_text(*words.shingles(np.concatenate(doc), np.concatenate(hashes),
                                                 n_words))


def set_digests(doc: np.ndarray, grams: np.ndarray, rows: int):
    """Sizes and 128-bit digests of the n-gram sets, and where each set starts in `grams`."""
    n = np.bincount(doc, minlength=rows)
    edges = np.append(0, np.cumsum(n))
    hi, lo = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        scrambled = words.mix(grams ^ np.uint64(0xA0761D6478BD642F))
        hi[full] = np.add.reduceat(scrambled, edges[full])
        lo[full] = np.bitwise_xor.reduceat(words.mix(scrambled * np.uint64(3)), edges[full])
    return n, hi, lo, edges


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()),
                                    pa.array(values.view(np.int64)))


def _first_pass(n_words: int, limit: int, percent: int):
    """Per document its set's size and digest, and the columns it enters the first pass with.

    Copies within a batch enter once. N-grams that a batch holds in several sets are known to be
    shared: the batch counts them itself and sends one entry for all (`twice`, on its first row).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = batch.num_rows
            doc, grams = incidence(batch.column(1), n_words)
            n, hi, lo, _ = set_digests(doc, grams, rows)
            zone = _in_zone(grams, limit)
            z = np.bincount(doc[zone], minlength=rows)
            _, first = np.unique(np.stack([hi, lo, n.astype(np.uint64)], 1), axis=0,
                                 return_index=True)
            enters = np.zeros(rows, bool)
            enters[first] = True
            take = enters[doc] & (zone | (n * percent <= SMALL_SET * 100)[doc])
            doc, grams, zone = doc[take], grams[take], zone[take]
            order = np.argsort(grams, kind="stable")
            ranked = grams[order]
            new = np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)]
            alone = np.empty(len(grams), bool)
            alone[order] = new & np.append(new[1:], True)[:len(new)]
            shared = np.unique(grams[~alone])
            twice = np.zeros(rows, np.int64)
            if rows:
                twice[0] = len(shared)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(n, pa.int32()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                pa.array(z, pa.int32()),
                pa.array(np.bincount(doc[~alone], minlength=rows), pa.int32()),
                pa.array(np.bincount(doc[~alone & zone], minlength=rows), pa.int32()),
                _lists(grams[alone], np.bincount(doc[alone], minlength=rows)),
                _lists(shared, twice),
            ], names=["doc_id", "n", "hi", "lo", "z", "own_all", "own_zone", "once", "twice"])
    return run


def _shared_entries(limit: int):
    """Of entries (gram, doc_id) sorted by gram: per document, how many a second entry matches.

    Streams over runs of equal grams; only the last entry of a batch is held back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_gram = held_doc = None  # the last entry, with its document until it is counted

        def counts(doc, gram):
            who, index = np.unique(doc, return_inverse=True)
            zone = _in_zone(gram, limit)
            return pa.RecordBatch.from_arrays([
                pa.array(who), pa.array(np.bincount(index, minlength=len(who)), pa.int64()),
                pa.array(np.bincount(index[zone], minlength=len(who)), pa.int64()),
            ], names=["doc_id", "more_all", "more_zone"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            same = gram[1:] == gram[:-1]
            shared = np.append(False, same) | np.append(same, False)
            if held_gram is not None and gram[0] == held_gram:
                shared[0] = True
                if held_doc is not None:
                    yield counts(np.array([held_doc], np.int64), np.array([held_gram], np.uint64))
            held_gram = gram[-1]
            held_doc = int(doc[-1]) if known[-1] and not shared[-1] else None
            take = shared & known
            if take.any():
                yield counts(doc[take], gram[take])
    return run


def _full_rows(n_words: int):
    """Whole n-gram sets of the documents that are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            doc, grams = incidence(batch.column(0), n_words)
            n, hi, lo, edges = set_digests(doc, grams, batch.num_rows)
            take = np.flatnonzero(n)
            _, first = np.unique(np.stack([hi, lo, n.astype(np.uint64)], 1)[take], axis=0,
                                 return_index=True)
            take = take[np.sort(first)]
            parts = [grams[edges[i]:edges[i + 1]] for i in take]
            yield pa.RecordBatch.from_arrays([
                pa.array(hi[take].view(np.int64)), pa.array(lo[take].view(np.int64)),
                pa.array(n[take], pa.int32()),
                _lists(np.concatenate(parts) if parts else np.zeros(0, np.uint64), n[take]),
            ], names=["hi", "lo", "n", "grams"])
    return run


def _verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set numbers whose exact overlap reaches the threshold."""
    left = rows.select(F.col("cid").alias("a"), F.col("grams").alias("ga"))
    right = rows.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - F.col("i")
    return (pairs.join(left, "a").join(right, "b").withColumn("i", both)
            .filter(100 * F.col("i") >= percent * union).select("a", "b"))


def _tiles(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Cut rows into runs of at most `TILE_ROWS` rows and about `TILE_GRAMS` n-grams."""
    cuts, at, held = [0], 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == TILE_ROWS or held + n > TILE_GRAMS):
            cuts.append(i)
            at, held = i, 0
        held += n
    return list(zip(cuts, [*cuts[1:], len(sizes)]))


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The product of two tiles of the incidence matrix: overlap counts of all their rows."""
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    out = []
    for rows, grams in ((a, left), (b, right)):
        at = np.searchsorted(shared, grams)
        at[at == len(shared)] = 0
        hit = shared[at] == grams if len(shared) else np.zeros(len(grams), bool)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        tile = np.zeros((len(rows), len(shared)), np.float32)
        tile[row[hit], at[hit]] = 1
        out.append(tile)
    return (out[0] @ out[1].T).astype(np.int64)


def _block_product(percent: int):
    """Links between the rows of one pair of blocks, as far as they join components."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        cid = table.column("cid").to_numpy()
        n = table.column("n").to_numpy().astype(np.int64)
        block = table.column("block").to_numpy()
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        roots = table.column("root").to_pylist()
        grams = [g.values.to_numpy() for g in table.column("grams")]
        links = []
        tiles = _tiles(n)
        for i, (a, b) in enumerate(tiles):
            for c, d in tiles[i:]:
                if 100 * n[b - 1] < percent * n[c]:
                    break  # rows are in order of size: no later row is small enough either
                mine = np.array([find(r) for r in roots[a:b]])
                others = np.array([find(r) for r in roots[c:d]])
                open_pairs = mine[:, None] != others[None, :]
                if first != second:
                    open_pairs &= block[a:b, None] != block[None, c:d]
                if not open_pairs.any():
                    continue
                both = _overlaps(grams[a:b], grams[c:d])
                union = n[a:b, None] + n[None, c:d] - both
                for x, y in zip(*np.nonzero(open_pairs & (100 * both >= percent * union))):
                    p, q = find(roots[a + x]), find(roots[c + y])
                    if p != q:
                        parent[p] = q
                        links.append((int(cid[a + x]), int(cid[c + y])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([y for _, y in links], pa.int64())})
    return run


def _near_sizes(percent: int):
    low, high = F.least("n", "m"), F.greatest("n", "m")
    return 100 * low.cast("long") >= percent * high.cast("long")


def ngram_components(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose word n-gram sets have a Jaccard similarity of `percent`/100.

    Reads columns `doc_id` (integer) and `text`; other columns are ignored. Words are what white
    space (space, tab to carriage return) separates, lower-cased A-Z only. A text with fewer words
    than `n_words` has one n-gram of all its words. Returns a row per input row:
    doc_id, n_shingles (size of the set), component_id (smallest doc_id that links reach), the digest of
    the set (`hi`, `lo`) and the digest of the set that names the component (`best_hi`, `best_lo`).

    A null text and a text without words have an empty set, which links with nothing: component_id
    is the row's own doc_id. Rows with equal sets are linked, repeated rows are all returned. Rows
    that share a doc_id but not the text are separate documents. A null doc_id takes part, but
    never gives the name of a component that has other ids; alone its component_id is null. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    limit = zone_limit(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    with scratch(spark) as tables:
        first = tables.table(docs.mapInArrow(_first_pass(n_words, limit, percent), _SETS))
        left = tables.table(_candidates(first, limit, percent))
        sets = tables.table(first.select("doc_id", "n", "hi", "lo"))
        tables.drop(first)  # its columns of n-grams are most of what is on disk
        texts = docs.join(left, docs["doc_id"].eqNullSafe(left["id"]), "left_semi").select("text")
        rows = tables.table(
            texts.mapInArrow(_full_rows(n_words), "hi long, lo long, n int, grams array<long>")
            .groupBy("hi", "lo", "n").agg(F.first("grams").alias("grams"))
            .withColumn("cid", F.monotonically_increasing_id()))
        roots = _linked(rows, limit, percent, tables)

        one = ["hi", "lo", "n"]
        row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hi", "lo")
        full = sets.filter("n > 0")
        classes = full.groupBy(*one).agg(F.min(row).alias("least"), F.count("*").alias("rows"))
        linked = roots.withColumnRenamed("node", "cid").union(
            roots.select("root", "root").distinct().toDF("cid", "root"))
        joined = tables.table(linked.join(rows.select("cid", *one), "cid").join(classes, one)
                              .select("root", *one, "least"))
        names = joined.groupBy("root").agg(F.min("least").alias("best"))
        named = joined.join(names, "root").select(*one, "best")
        # Sets of one row that link with nothing need no label.
        labels = named.union(classes.filter("rows > 1").join(named, one, "left_anti")
                             .select(*one, F.col("least").alias("best")))
        out = sets.select("doc_id", "n", "hi", "lo").join(labels, one, "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
            .alias("component_id"), "hi", "lo",
            F.coalesce("best.hi", "hi").alias("best_hi"), F.coalesce("best.lo", "lo").alias("best_lo"))
        return keep(out)


def _candidates(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Ids of the documents whose shared n-grams reach their size-derived bound."""
    entries = (sets.select(F.explode("once").alias("gram"), "doc_id")
               .union(sets.select(F.explode("twice").alias("gram"),
                                  F.lit(None).cast("long").alias("doc_id"))))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = (entries.repartition(parts, "gram").sortWithinPartitions("gram")
            .mapInArrow(_shared_entries(limit), "doc_id long, more_all long, more_zone long")
            .groupBy("doc_id").agg(F.sum("more_all").alias("more_all"),
                                   F.sum("more_zone").alias("more_zone")))
    met_all = F.col("own_all") + F.coalesce("more_all", F.lit(0))
    met_zone = F.col("own_zone") + F.coalesce("more_zone", F.lit(0))
    enough = (
        (F.col("z") - met_zone <= F.floor(F.col("n") * (100 - percent) / 100))
        & ((F.col("n") > SMALL_SET) | (100 * met_all >= percent * F.col("n")))
    ) | F.col("doc_id").isNull()
    return (sets.filter("n > 0").select("doc_id", "n", "z", "own_all", "own_zone")
            .join(more, "doc_id", "left").filter(enough)
            .select(F.col("doc_id").alias("id")).distinct())


def _columns(rows: DataFrame, limit: int, percent: int) -> DataFrame:
    """(col, cid, n): the rarest columns of each set, one more than a linked pair can differ by.

    There are two orders of columns: the zone for sets above `SMALL_SET`, and all n-grams for sets
    up to that size and their possible partners, and for the rare large set with hardly a column in
    the zone. Every pair that can link is in one of them together.
    """
    slack = F.floor(F.col("n") * (100 - percent) / 100).cast("int")
    # Spark's longs are signed: hashes below the limit are 0 <= x < limit, or wrap around.
    if limit >= 2 ** 64:
        zone = F.col("grams")
    elif limit <= 2 ** 63:
        zone = F.filter("grams", lambda x: (x >= 0) & (x < F.lit(limit)))
    else:
        zone = F.filter("grams", lambda x: (x >= 0) | (x < F.lit(limit - 2 ** 64)))
    sized = rows.withColumn("slack", slack).withColumn("zone", zone)
    cut = sized.filter(F.col("n") > SMALL_SET).select(
        F.lit(0).alias("order"), "cid", "n", "slack", F.col("zone").alias("cols"))
    whole = sized.filter(
        (F.col("n") * percent <= SMALL_SET * 100) | (F.size("zone") <= F.col("slack"))).select(
        F.lit(1).alias("order"), "cid", "n", "slack", F.col("grams").alias("cols"))
    both = cut.union(whole)
    flat = both.select("order", "cid", "n", "slack", F.size("cols").alias("all"),
                       F.explode("cols").alias("col"))
    held = flat.groupBy("order", "col").agg(F.count("*").alias("df")).filter("df > 1")
    same = [F.first(c).alias(c) for c in ("n", "slack", "all")]
    return (flat.join(held, ["order", "col"]).groupBy("order", "cid")
            .agg(*same, F.sort_array(F.collect_list(F.struct("df", "col"))).alias("met"))
            # Columns of this set alone come first in the order and meet nothing.
            .withColumn("take", F.col("slack") + 1 - (F.col("all") - F.size("met")))
            .filter("take > 0")
            .select("order", F.explode(F.slice("met", F.lit(1), F.col("take"))).alias("c"),
                    "cid", "n")
            .select("order", F.col("c.col").alias("col"), "cid", "n"))


def _linked(rows: DataFrame, limit: int, percent: int, tables) -> DataFrame:
    """(node, root) of the sets that link with another."""
    key = ["order", "col"]
    lists = tables.table(_columns(rows, limit, percent))
    links = None
    roots = None
    for block in range(HUB_BLOCKS):
        open_lists = lists if roots is None else _several(lists, roots, key)
        rank = F.struct(F.xxhash64("cid", F.lit(block)), "cid", "n")
        hubs = open_lists.groupBy(*key).agg(F.min(rank).alias("h")).select(
            *key, F.col("h.cid").alias("hub"), F.col("h.n").alias("m"))
        pairs = (open_lists.join(hubs, key).filter(F.col("cid") != F.col("hub"))
                 .filter(_near_sizes(percent))
                 .select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b"))
                 .distinct())
        found = tables.table(_verified(pairs, rows, percent))
        links = found if links is None else links.union(found)
        roots = components(links, tables)
    # The last blocks: what still lies in different components, each column beside its hub.
    open_lists = tables.table(_several(lists, roots, key))
    rank = F.struct(F.xxhash64("cid", F.lit(HUB_BLOCKS)), "cid")
    hubs = open_lists.groupBy(*key).agg(F.min(rank)["cid"].alias("hub"))
    members = tables.table(open_lists.join(hubs, key).select("hub", "cid", "root").distinct())
    blocks = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("k"))
    mine, other = F.col("block"), F.col("other")
    placed = (members.join(blocks, "hub")
              .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
              .select("hub", "cid", "root", "block", F.least(mine, other).alias("first"),
                      F.greatest(mine, other).alias("second")))
    found = tables.table(
        placed.join(rows.select("cid", "n", "grams"), "cid")
        .groupBy("hub", "first", "second").applyInArrow(_block_product(percent), "a long, b long"))
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
                      .union(found), tables)


def _several(lists: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """The entries of columns whose sets are in more than one component, with the component."""
    marked = (lists.select("cid", *key, "n")
              .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
              .withColumn("root", F.coalesce("root", "cid")))
    several = marked.groupBy(*key).agg(F.min("root").alias("x"), F.max("root").alias("y"))
    return marked.join(several.filter("x < y").select(*key), key, "left_semi")


def _digests(n_words: int, names: list[str]):
    """Rows with the size and digest of their n-gram set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            n, hi, lo, _ = set_digests(*incidence(texts, n_words), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(n, pa.int32()), pa.array(hi.view(np.int64)),
                                 pa.array(lo.view(np.int64))], names=names)
    return run


def one_per_component(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one of each component stays.

    The document with the smallest doc_id stays, of several rows with that id the one whose n-gram
    set has the smallest digest, of equal sets one row. Rows without an id only give way to a linked
    document with an id or to an equal set. Documents without words stay, one per doc_id. Needs
    no column but `doc_id` and `text`; clashing names of helper columns do not matter.
    """
    found = ngram_components(docs, n_words, percent)
    marked = found.withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("component_id"))
        & (F.col("hi") == F.col("best_hi")) & (F.col("lo") == F.col("best_lo")))
    ids = marked.groupBy("doc_id").agg(F.count("*").alias("rows"),
                                       F.max("stays").alias("stays"))
    several = ids.filter("doc_id is null or rows > 1").select(F.col("doc_id").alias("_several"))
    gone = ids.filter("doc_id is null or rows > 1 or not stays").select(
        F.col("doc_id").alias("_gone"))
    single = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    # Rows that share an id are told apart by their sets.
    repeated = docs.join(several, docs["doc_id"].eqNullSafe(several["_several"]), "left_semi")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    names[docs.columns.index("text")] = "text"
    id_name = names[docs.columns.index("doc_id")]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    key = ["_n", "_hi", "_lo"]
    told = repeated.toDF(*names).mapInArrow(_digests(n_words, names + key),
                                            schema + ", _n int, _hi long, _lo long")
    kept = (marked.filter("stays").select(
        F.col("doc_id").alias("_id"), F.col("n_shingles").cast("int").alias("_n"),
        F.col("hi").alias("_hi"), F.col("lo").alias("_lo")).distinct()
        .join(several, F.col("_id").eqNullSafe(F.col("_several")), "left_semi"))
    same = told[id_name].eqNullSafe(kept["_id"])
    for c in key:
        same = same & (told[c] == kept[c])
    stay = (told.join(kept, same, "left_semi").dropDuplicates([id_name, *key])
            .select(*names).toDF(*docs.columns))
    return single.unionByName(stay)
