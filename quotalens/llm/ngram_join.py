"""Size-aware heavy-light join of n-gram sets by Jaccard similarity.

Equal sets are collapsed first.  Elements are ordered by their frequency class, rare first.  Two sets
that are similar enough share elements in their prefixes under that order, so only elements of prefixes
that occur in another set matter.  Small sets enumerate the subsets of two such elements as keys; large
sets look up the inverted lists of single elements; the boundary is the size at which the subsets of all
smaller sets and the lists scanned by all larger ones cost least together.

Sets under one key are never paired with each other as they come.  Each is first compared with one set
of its key.  Links found so far are merged to components, and then only sets of a key that are not of
the key's main component are held against the others of it, under bounds on the intersection that
follow from sizes, positions in the order and bitmaps.  What passes is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quotalens.llm import chunks
from quotalens.llm.components import components
from quotalens.llm.hashing import LOWER, Prefix, mix, text_bytes, unique_names, word_names, word_spans
from quotalens.llm.store import saved

WORDS, PERCENT = 5, 80
BITMAP = 16  # longs
#: Making and shuffling one subset costs as much as comparing about 64 entries of a list; and about one entry
#: in 16 scans its list, as the others are settled by their comparison with its centre.
SUBSET_COST = 64 * 16
SETS = "doc_id long, text_key long, n long, node long, z long, scan double, elements array<long>, bits array<long>"


class _Sets:
    """The n-gram sets of a chunk's texts."""

    def __init__(self, rows: pa.Table, k: int):
        data, at = text_bytes(rows["text"])
        data = LOWER[data]
        begin, end, first = word_spans(data, at)
        words = Prefix(word_names(data, begin, end))
        counts = np.diff(first)
        number = np.arange(len(begin)) - np.repeat(first[:-1], counts)
        left = np.repeat(counts, counts) - number
        start = np.flatnonzero((left >= k) | (number == 0))
        size = np.minimum(left[start], k)
        names = mix(words.names(start, size) + size.astype(np.uint64))
        self.names, place, _ = unique_names(names)
        owner = np.repeat(np.arange(len(counts)), counts)[start]
        pairs = np.unique(owner * max(len(self.names), 1) + place)
        self.owner, self.place = pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)
        self.n = np.bincount(self.owner, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.nodes = np.zeros(len(counts), np.uint64)
        full = np.flatnonzero(self.n)
        if len(full):
            self.nodes[full] = mix(np.add.reduceat(mix(self.names[self.place] ^ np.uint64(0x5851F42D4C957F2D)), self.first[full]) + self.n[full].astype(np.uint64))
        # the first text of each set in this chunk
        self.leaders = full[np.unique(self.nodes[full], return_index=True)[1]]

    def question(self) -> tuple[np.ndarray, np.ndarray]:
        """Names of elements and of sets, with the number of sets (within the chunk) that hold them."""
        own = np.isin(self.owner, self.leaders)
        times = np.bincount(self.place[own], minlength=len(self.names))
        names, place, _ = unique_names(np.concatenate([self.names, self.nodes[self.leaders]]))
        counts = np.bincount(place, weights=np.concatenate([times, np.ones(len(self.leaders))]))
        return names, counts


def _needed(n: Column | np.ndarray, percent: int):
    """The least intersection of a set of n elements with any set that is similar enough: ceil(percent n / 100)."""
    return (percent * n + 99) // 100 if isinstance(n, np.ndarray) else F.expr(f"({percent} * n + 99) div 100")


def prepared_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_key (xxhash64 of the text), n, node (the name of its set; null if empty), and for one document of
    each set that can have a partner: elements in the global order, z (how many of them occur nowhere
    else, these come first), scan (length of the lists of its prefix) and a bitmap of its elements."""
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    dealt, ranges = chunks.chunked(keyed, ["text_key"])

    def ask(chunk: int, rows: pa.Table) -> pa.Table:
        names, counts = _Sets(rows, k).question()
        return chunks.asked(chunk, names, counts, ranges, b"")

    def order(chunk: int, rows: pa.Table, back: pa.Table) -> pa.Table:
        sets = _Sets(rows, k)
        kinds, _ = chunks.read_answer(back, ranges)
        names, _ = sets.question()
        kind_of = kinds[np.searchsorted(names, sets.names)] if len(names) else kinds
        shared = kinds[np.searchsorted(names, sets.nodes[sets.leaders])] if len(names) else kinds
        leads = np.zeros(len(sets.n), bool)
        leads[sets.leaders[(shared == 0) | (shared >= chunks.FIRST)]] = True
        kind_of = kind_of & (chunks.FIRST - 1)

        prefix = sets.n - _needed(sets.n, percent) + 1
        alone = np.concatenate([[0], np.cumsum(kind_of[sets.place] == 0)])
        z = alone[sets.first[1:]] - alone[sets.first[:-1]]
        z = np.where(leads & (sets.n > 0) & (z < prefix), z, -1)
        scans, elements, bits = [], [], []
        for i in range(len(z)):
            if z[i] < 0:
                scans.append(None), elements.append(None), bits.append(None)
                continue
            own = sets.place[sets.first[i] : sets.first[i + 1]]  # in the order of names already
            own = own[np.argsort(kind_of[own], kind="stable")]
            held = sets.names[own]
            spot = held >> np.uint64(54)
            row = np.zeros(BITMAP, np.uint64)
            np.bitwise_or.at(row, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
            scans.append(float(np.exp2((kind_of[own[z[i] : prefix[i]]].astype(float) - 1) / 4).sum()))
            elements.append(held.view(np.int64))
            bits.append(row.view(np.int64))
        return pa.table({
            "doc_id": rows["doc_id"], "text_key": pc.struct_field(rows["rest"], "text_key"), "n": pa.array(sets.n.astype(np.int64)), "node": pa.array(sets.nodes.view(np.int64), mask=sets.n == 0), "z": pa.array(z, mask=z < 0),
            "scan": pa.array(scans, pa.float64()), "elements": pa.array(elements, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64())),
        })

    answers = chunks.answered(chunks.first_pass(dealt, ask), ranges)
    return saved(chunks.next_pass(dealt, answers, order, SETS), "sets")


def size_boundary(sets: DataFrame, percent: int) -> int:
    """The largest size of a small set.  Costs are summed by size class, about 200 of them at most."""
    pairs = SUBSET_COST * (F.col("m") + 1) * F.col("m") / 2
    costs = (
        sets.withColumn("m", F.col("n") - _needed(F.col("n"), percent) + 1 - F.col("z"))
        .groupBy(F.floor(F.log2("n") * 12).alias("size_class")).agg(F.sum(pairs).alias("subsets"), F.sum("scan").alias("scans"), F.max("n").alias("largest")).orderBy("size_class").collect()
    )
    best, boundary, done = sum(r["scans"] for r in costs), 0, 0.0
    total = best
    for r in costs:
        done += r["subsets"] - r["scans"]
        if total + done < best:
            best, boundary = total + done, r["largest"]
    return boundary


def join_keys(sets: DataFrame, boundary: int, percent: int) -> DataFrame:
    """(key, node, n, pos): subsets of two elements for small sets, single elements for large sets and for the
    small ones that are large enough to be similar to them.

    If a key is the first that two sets share, their intersection has at most the lesser n - pos.
    """
    p = F.col("n") - _needed(F.col("n"), percent) + 1
    entry = F.transform(F.slice("elements", (F.col("z") + 1).cast("int"), (p + 1 - F.col("z")).cast("int")), lambda e, i: F.named_struct(F.lit("e"), e, F.lit("pos"), F.col("z") + i))
    base = sets.withColumn("two", entry).withColumn("one", F.slice("two", F.lit(1), F.size("two") - F.when(F.col("n") > p, 1).otherwise(0)))
    pair = lambda a, b: F.named_struct(F.lit("key"), F.xxhash64(a["e"], b["e"]), F.lit("pos"), b["pos"] - 1)
    subsets = F.flatten(F.transform("two", lambda a, i: F.transform(F.filter("two", lambda b, j: j > i), lambda b: pair(a, b))))
    single = F.transform("one", lambda a: F.named_struct(F.lit("key"), F.xxhash64(F.lit("one"), a["e"]), F.lit("pos"), a["pos"]))
    small = base.where(F.col("n") <= boundary).select(F.explode(subsets).alias("s"), "node", "n")
    large = base.where(100 * F.col("n") >= percent * (boundary + 1)).select(F.explode(single).alias("s"), "node", "n")
    return small.union(large).select("s.key", "node", "n", "s.pos")


def _may_link(a: str, b: str, percent: int, bitmaps: bool = False) -> Column:
    """Necessary conditions on two sets that meet under their first common key, cheapest first."""
    n1, n2, pos1, pos2 = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (a, b))
    total = n1 + n2
    out = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1) & ((100 + percent) * F.least(n1 - pos1, n2 - pos2) >= percent * total)
    if bitmaps:
        for t, u, n in ((a, b, n1), (b, a, n2)):
            missing = sum((F.bit_count(F.get(f"{t}.bits", F.lit(i)).bitwiseAND(F.bitwise_not(F.get(f"{u}.bits", F.lit(i))))) for i in range(BITMAP)), F.lit(0))
            out = out & ((100 + percent) * (n - missing) >= percent * total)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where((100 + percent) * both >= percent * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def linked_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of all sets with a link.  ``sets``: rows of prepared_sets with elements."""
    keys = join_keys(sets, size_boundary(sets, percent), percent)
    # the centre of a key is the set with most room left behind it
    span = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min(F.struct((F.col("pos") / F.col("n")).alias("room"), "node", "n", "pos")).alias("y")).where("low < high")
    keys = saved(keys.join(span.select("key", "y"), "key"), "keys")  # keys of two sets or more

    stars = keys.select(F.struct("node", "n", "pos").alias("x"), "y").where("x.node <> y.node")
    stars = stars.where(_may_link("x", "y", percent)).select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    links = saved(verified(stars, sets, percent), "links")
    merged = components(links)

    own = keys.select("key", "node", "n", "pos").join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    main = own.groupBy("key", "component").agg(F.count("*").alias("times")).groupBy("key").agg(F.max_by("component", F.struct("times", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = own.join(main.drop("kinds"), "key").join(sets.select("node", "bits"), "node")
    mixed = saved(mixed, "mixed")
    x, y = mixed.where("component <> main").alias("x"), mixed.alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & _may_link("x", "y", percent, bitmaps=True))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    # links between components, not between their sets: a component of thousands is one node from here on
    of = own.select("node", "component").distinct()
    more = verified(rest, sets, percent).join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    wider = components(more).toDF("component", "wider")
    return own.select("node", "component").distinct().join(wider, "component", "left").select("node", F.coalesce("wider", "component").alias("component"))


def linked_documents(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """ngram_components with the keys of rows: doc_id, text_key (xxhash64 of the text), n_shingles,
    component_id and first_key.

    The first row of a component is the least by (doc_id, text_key), null ids last; component_id and
    first_key are its id and key.  A text without words has no first_key.
    """
    base = prepared_sets(docs, k, percent)
    sets = base.where("elements IS NOT NULL")
    merged = linked_sets(sets, percent)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    nodes = base.where("node IS NOT NULL").groupBy("node").agg(F.min(row).alias("least")).join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = nodes.groupBy("component").agg(F.min("least").alias("first"))
    ids = nodes.join(least, "component").select(F.col("node").alias("of"), "first.doc_id", "first.text_key").toDF("of", "component_id", "first_key")
    component_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return base.select("doc_id", "text_key", "n", "node").join(ids, F.col("node") == F.col("of"), "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), component_id, "first_key")


def ngram_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose word n-gram sets have a Jaccard similarity of ``percent`` or more.

    ``docs`` needs doc_id and text; other columns are ignored.  A-Z is folded; words are runs without
    ASCII white space.  A text with fewer than ``k`` words is one n-gram; a null or empty text has none
    and is linked with nothing.  Returns per row doc_id, n_shingles and component_id, the least doc_id
    reachable by links.  Rows that share a doc_id are
    separate texts, each with its own component.  A null doc_id takes
    part, but is no component's id unless all ids of the component are null.  An empty table gives an
    empty table.  Elements and sets are compared by 64-bit names.
    """
    return linked_documents(docs, k, percent).select("doc_id", "n_shingles", "component_id")
