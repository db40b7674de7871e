"""N-gram Jaccard self-join by universe-partition pigeonhole, verified exactly.

A document is the set of its distinct word 4-grams. Sets of equal content form a class and one document stands for it. Sizes fall
into bands wide enough that linked sets lie in the same or in neighbouring bands; the scheme of a band serves its sets with each
other and with the next band. Two linked sets of a scheme differ in at most H tokens. The scheme hashes the universe of tokens into
segments, so a set falls into subsets; a segment with allowance 0 is indexed by its subset, one with allowance 1 also by the subset's
one-deletion neighbourhood. With allowances that sum (each plus one) to more than H, linked sets agree within some segment's
allowance. A cost model chooses how many segments get which allowance, from the number of sets in the bands and their mean
resemblance, both computed over all sets.

An index entry with FREQUENT sets or more is not used as it is. First its sets propose links through it (see below), for SETTLING rounds at
most; where that makes one component of all its sets, nothing is left to find. The sets of the other such entries are crowded and
are indexed once more among themselves, under schemes of FINER times as many segments. There each set may leave out its most frequent subsets up to the surplus of segments over H + 1:
linked sets still share the rarest of their common subsets, as both order subsets alike. So a set that differs from the core of a
crowd in more than H tokens leaves the crowd's entries, and passages which many documents share do not bring them together, without
a link being lost. Empty subsets count as the most frequent ones in either index.

Sets that share an entry are not paired with each other. Each proposes the entry's most central member outside its own component;
proposals are checked by size, by the distance of parity bitmaps (a lower bound of the difference) and then on the texts. Links
found merge components, and when a round finds none, or after ROUNDS, every pair across components that still share an entry is
checked, block by block, against both bounds, and what they allow on the texts. Pairs within a component cannot change a result.

Defined cases: a null or blank text has no shingles and links with nothing; a row without an id has no component (null) and links
nothing; rows that share an id are one node, with the links of all their texts; repeated rows give repeated result rows; an empty table
gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinor.llm.common import by_bytes, few_or_shuffled, map_batches
from affinor.llm.components import components
from affinor.session import cut_lineage

N = 4
NUM, DEN = 85, 100  # the similarity bound as a fraction
FREQUENT = 32  # sets of an entry from which on they are crowded
FINER = 5
ROUNDS = 4
SETTLING = 3
BLOCK = 2000  # members of an entry that are compared at once
BUCKETS = 1 << 20
_LOWER = bytes(range(256)).lower()
_M1, _M2, _P = np.uint64(0xff51afd7ed558ccd), np.uint64(0xc4ceb9fe1a85ec53), np.uint64(0x9e3779b97f4a7c15)
PROFILE = "doc_id long, n long, fp binary, least long, bitmap binary"
ENTRY = "key long, doc_id long, n int, scheme short, kind byte, room int"


def words_of(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z: runs between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """64-bit tokens of a text's distinct word n-grams, sorted."""

    def __init__(self, n: int = N, remember: int = 100_000):
        self.n, self.remember, self.seen = n, remember, {}

    def tokens(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        if len(self.seen) > self.remember:
            self.seen = {}
        for w in set(words).difference(self.seen):
            self.seen[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        k = min(self.n, len(h))
        acc = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            acc = acc * _P + h[j:len(h) - k + 1 + j]
        return np.unique(mix(acc))


def shingles(text: str | None, n: int = N) -> set:
    """The shingles themselves, for verification."""
    words = words_of(text)
    return set(zip(*(words[j:] for j in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def bands(limit: int, num: int = NUM, den: int = DEN) -> list[int]:
    """First size of every band up to one beyond `limit`; a linked pair never skips a band."""
    out = [1]
    while out[-1] <= limit * den // num + 1:
        out.append(out[-1] * den // num + 1)
    return [*out, out[-1] * den // num + 1]


def most_apart(r: int, s: int, num: int = NUM, den: int = DEN) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (den - num) * (r + s) // (den + num)


def allocate(h: int, sets: float, size: float, resemblance: float) -> tuple[int, int, int]:
    """Segments, how many of them (the first) get allowance 1, and the slack, at the least estimated cost: entries written plus pairs
    of random sets that meet in an entry."""
    shared, best = 2 * resemblance / (1 + resemblance), None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        need, slack = h + 1, 0
        for _ in range(3):  # the slack takes in the expected empty segments, which depend on the number of segments
            m = max(1, math.ceil((need + slack) / (1 + share)))
            slack = math.ceil(0.1 * h + 2 * (1 - share) * m * math.exp(-size / m))
        m = max(1, math.ceil((need + slack) / (1 + share)))
        ones = min(m, need + slack - m)
        slack = m + ones - need
        c = size / m
        meet = (m - ones) * shared ** c + ones * (shared ** c + 2 * c * shared ** max(c - 1, 0) * (1 - shared))
        cost = sets * (m + ones * c) + sets * sets / 2 * meet
        if best is None or cost < best[0]:
            best = (cost, (m, ones, slack))
    return best[1]


def profile(docs: DataFrame) -> DataFrame:
    """Size, fingerprint, least token and parity bitmap of every document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in (part for whole in batches for part in by_bytes(whole, 1)):
            n, fp, least, bitmap = [], [], [], []
            for t in b.column(1).to_pylist():
                x = sh.tokens(t)
                n.append(len(x))
                fp.append(xxhash.xxh3_128_digest(x.tobytes()))
                least.append(int(x[0].astype(np.int64)) if len(x) else None)
                bits = 1 << max(8, len(x).bit_length())
                bitmap.append(np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(least, pa.int64()), pa.array(bitmap, pa.binary())],
                                  names=["doc_id", "n", "fp", "least", "bitmap"])
    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, run, PROFILE)


def schemes(sets: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """band: (first size, segments, with allowance 1, slack), from statistics of all class representatives. There are as many bands as
    the logarithm of the largest size."""
    top = sets.agg(F.max("n")).first()[0] or 0
    first = bands(top)
    band = sets.select(F.explode(F.array(*[F.lit(i).cast("int") for i in (0, 1)])).alias("down"), "n", "least").select(
        (F.expr("size(filter(array(" + ",".join(map(str, first)) + "), x -> x <= n))") - 1 - F.col("down")).alias("k"), "n", "least")
    # two sets have the same least token with the probability of their resemblance
    per = band.groupBy("k", "least").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("k").agg(
        F.sum("c").alias("sets"), F.sum("s").alias("size"), F.sum(F.col("c") * (F.col("c") - 1).cast("double")).alias("same"))
    out = {}
    for r in per.collect():
        if r.k < 0 or r.sets < 2:
            continue
        widest = first[r.k + 1] - 1
        h = most_apart(widest, widest * DEN // NUM)
        if h:  # otherwise linked sets are equal, and those share a class
            out[r.k] = allocate(h, r.sets, r.size / r.sets, r.same / (r.sets * (r.sets - 1.0)))
    return out


def segment_entries(x: np.ndarray, scheme: int, m: int, ones: int, slack: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and kinds (0: subset under allowance 0, 1: subset under allowance 1, 2: one-deletion neighbour) of a set, and how much of
    the slack its empty segments have left. Empty subsets count as the most frequent ones."""
    seed = np.uint64((scheme + 1) * int(_P) & 0xffffffffffffffff)
    seg = (mix(x ^ seed) % np.uint64(m)).astype(np.int64)
    part = mix(x + seed)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, part)
    salt = mix(np.arange(m, dtype=np.uint64) * _P + seed)
    empty = np.flatnonzero(np.bincount(seg, minlength=m)[ones:] == 0) + ones
    keep = np.ones(m, bool)
    keep[empty[:slack]] = False
    keys, kinds = mix(total ^ salt)[keep], (np.arange(m) < ones).astype(np.int8)[keep]
    if ones:
        one = seg < ones
        keys = np.concatenate([keys, mix((total[seg[one]] - part[one]) ^ salt[seg[one]])])
        kinds = np.concatenate([kinds, np.full(int(one.sum()), 2, np.int8)])
    return keys.astype(np.int64), kinds, max(0, slack - len(empty))


def entries(docs: DataFrame, plan: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Index entries of every document, flat."""
    first = np.array(bands(10 ** 12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in batches:
            for some in by_bytes(b, 1, 1_000_000):
                parts = []
                for doc, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    x = sh.tokens(t)
                    k = int(np.searchsorted(first, len(x), side="right")) - 1
                    for scheme in (k, k - 1) if len(x) else ():
                        if scheme in plan:
                            keys, kinds, room = segment_entries(x, scheme, *plan[scheme])
                            parts.append((keys, doc, len(x), scheme, kinds, room))
                if parts:
                    sizes = [len(p[0]) for p in parts]
                    yield pa.record_batch([pa.array(np.concatenate([p[0] for p in parts])), *(pa.array(np.repeat(np.array([p[j] for p in parts], t), sizes)) for j, t in ((1, np.int64), (2, np.int32), (3, np.int16))),
                                           pa.array(np.concatenate([p[4] for p in parts])), pa.array(np.repeat(np.array([p[5] for p in parts], np.int32), sizes))],
                                          names=["key", "doc_id", "n", "scheme", "kind", "room"])
    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, run, ENTRY)


def finer(plan: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
    """Schemes for crowds: many segments, all with allowance 0; what exceeds H + 1 is slack."""
    return {k: (FINER * (m + ones - slack), 0, (FINER - 1) * (m + ones - slack)) for k, (m, ones, slack) in plan.items()}


def counted(all_entries: DataFrame) -> DataFrame:
    """Entries of at least two sets, with their number of sets."""
    return cut_lineage(all_entries.withColumn("c", F.count("*").over(Window.partitionBy("key"))).filter("c > 1"))


def scored(shared: DataFrame) -> DataFrame:
    """The score of a document is high if it shares many entries with many others."""
    return shared.drop("c").join(shared.groupBy("doc_id").agg(F.sum("c").alias("score")), "doc_id")


def unsettled(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries of sets in several components, with the component of each set."""
    w = Window.partitionBy("key")
    label = shared.drop("component").join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    return cut_lineage(label.withColumn("_lo", F.min("component").over(w)).withColumn("_hi", F.max("component").over(w)).filter("_lo < _hi").drop("_lo", "_hi"))


def settle(frequent: DataFrame, docs: DataFrame, reps: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the frequent entries, and the links with those found through them."""
    left, comp = scored(frequent), links_to_components(links)
    for turn in range(SETTLING + 1):
        left = unsettled(left, comp)
        if turn == SETTLING or left.isEmpty():
            break
        new = cut_lineage(linked(near_enough(proposals(left), reps), docs))
        if new.isEmpty():
            break
        links = links.unionByName(new)
        comp = links_to_components(links)
    return left, links


def shared_entries(docs: DataFrame, plan: dict[int, tuple[int, int, int]], reps: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, doc_id, n, exact, score: the entries to be searched for links; and the links known so far."""
    cols = ["key", "doc_id", "n", (F.col("kind") < 2).alias("exact"), "c"]
    coarse = counted(entries(docs, plan))
    frequent, links = settle(coarse.filter(F.col("c") >= FREQUENT).select(*cols), docs, reps, links)
    crowd = cut_lineage(frequent.select("doc_id").distinct())
    out = coarse.filter(F.col("c") < FREQUENT).select(*cols)
    if not crowd.isEmpty():
        fine = counted(entries(docs.join(few_or_shuffled(crowd), "doc_id", "left_semi"), finer(plan)))
        # rows that share an id share the smaller room, so each of their sets leaves out no more than it may
        mine = Window.partitionBy("doc_id", "scheme")
        drop = (fine.filter(F.col("c") >= FREQUENT).withColumn("_r", F.row_number().over(mine.orderBy(F.col("c").desc(), "key")))
                .withColumn("_room", F.min("room").over(mine)).filter("_r <= _room").select("key", "doc_id").distinct())
        out = out.unionByName(fine.join(drop, ["key", "doc_id"], "left_anti").select(*cols))
    return scored(cut_lineage(out.distinct())), links


def near_enough(pairs: DataFrame, prof: DataFrame) -> DataFrame:
    """Pairs that sizes and parity bitmaps allow. A larger bitmap folds onto a smaller one by exclusive or."""
    bits = prof.select("doc_id", "n", "bitmap")
    both = (pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba")), "a")
            .join(bits.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb")), "b")
            .filter((F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, x, y in zip(*(t.column(c).to_pylist() for c in ("na", "nb", "ba", "bb"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[:len(y) // 2] ^ y[len(y) // 2:]
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= most_apart(na, nb))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.select("a", "b", "na", "nb", "ba", "bb").transform(map_batches, run, "a long, b long").distinct()


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that reach the similarity bound, counted on the shingles of the texts. Only texts in some pair are shuffled: a set of
    hashed ids, of fixed size at most, thins out the others where they are read."""
    pairs = cut_lineage(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    buckets = ids.select(F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)).alias("_bucket")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(buckets), F.pmod(F.xxhash64("_id"), F.lit(BUCKETS)) == F.col("_bucket"), "left_semi")
    both = (pairs.join(texts.select(F.col("_id").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("_id").alias("b"), F.col("text").alias("tb")), "b").sortWithinPartitions("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict = OrderedDict()

        def sets(doc, text):
            key = (doc, hash(text))
            if key not in recent:
                recent[key] = shingles(text)
                if len(recent) > 8:
                    recent.popitem(last=False)
            recent.move_to_end(key)
            return recent[key]

        for t in batches:
            keep = []
            for a, b, ta, tb in zip(*(t.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                x, y = sets(a, ta), shingles(tb)
                common = len(x & y)
                keep.append(bool(common) and DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return both.select("a", "b", "ta", "tb").transform(map_batches, run, "a long, b long").distinct()


def proposals(shared: DataFrame) -> DataFrame:
    """At most one pair per document: of the most central members of the entries it is in, if outside its own component, the one it
    shares most entries with."""
    w = Window.partitionBy("key")
    lead = F.max(F.when(F.col("exact"), F.struct("score", (-F.col("doc_id")).alias("neg"), "component"))).over(w)
    votes = (shared.withColumn("lead", lead).filter(F.col("lead").isNotNull() & (F.col("lead.component") != F.col("component")))
             .groupBy("doc_id", (-F.col("lead.neg")).alias("to")).agg(F.count("*").alias("v")))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("v", (-F.col("to")).alias("neg"))).alias("m")).select("doc_id", (-F.col("m.neg")).alias("to"))
    return best.select(F.least("doc_id", "to").alias("a"), F.greatest("doc_id", "to").alias("b")).distinct()


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Groups of sorted rows, across batches."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        key = np.column_stack([t.column(c).to_numpy() for c in by])
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:]):
            yield t.slice(i, j - i)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held


def across(shared: DataFrame, prof: DataFrame, block: int = 0) -> DataFrame:
    """Pairs of an entry's members in different components, as far as sizes and parity bitmaps allow. Members of an entry are dealt
    into blocks and each pair of blocks is compared in memory of a bounded size, so pairs that the bounds rule out are never rows."""
    rows = shared.join(prof.select("doc_id", F.col("n").alias("size"), "bitmap"), "doc_id")
    n = F.ceil(F.count("*").over(Window.partitionBy("key")) / F.lit(block or BLOCK)).cast("int")
    dealt = rows.withColumn("_n", n).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("_n")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("key", F.least("own", "_j").alias("lo"), F.greatest("own", "_j").alias("hi"), "own", "doc_id", "component", "exact", "size", "bitmap")
    by = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, by):
            own, doc, comp, exact, size = (t.column(c).to_numpy() for c in ("own", "doc_id", "component", "exact", "size"))
            if (comp == comp[0]).all():
                continue
            maps = [np.frombuffer(x, np.uint64) for x in t.column("bitmap").to_pylist()]
            least = min(map(len, maps))
            bits = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in maps])
            two = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
            a, b = [], []
            for i in range(len(doc) - 1):
                j = slice(i + 1, None)
                ok = (comp[j] != comp[i]) & (exact[j] | exact[i]) & (np.minimum(size[j], size[i]) * DEN >= np.maximum(size[j], size[i]) * NUM)
                if two:
                    ok &= own[j] != own[i]
                at = np.flatnonzero(ok) + i + 1
                at = at[np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1) <= (DEN - NUM) * (size[at] + size[i]) // (DEN + NUM)]
                a.extend([doc[i]] * len(at))
                b.extend(doc[at])
            if a:
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
    return dealt.repartition(*by).sortWithinPartitions(*by).transform(map_batches, run, "a long, b long").distinct()


def links_to_components(links: DataFrame) -> DataFrame:
    return cut_lineage(components(links).withColumnRenamed("id", "doc_id"))


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every document."""
    rows = cut_lineage(profile(docs))
    full = rows.filter("doc_id IS NOT NULL AND n > 0")
    classes = full.groupBy("fp", "n").agg(F.min("doc_id").alias("rep"))
    links = cut_lineage(full.select("doc_id", "fp", "n").join(classes, ["fp", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    reps = cut_lineage(full.join(links.filter("a = b").select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "fp"]))
    copies = links.groupBy("a").agg(F.min(F.col("b") != F.col("a")).alias("copy")).filter("copy").select(F.col("a").alias("doc_id"))
    plan = schemes(reps)
    links = links.filter("a <> b")
    distinct_docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").join(few_or_shuffled(copies), "doc_id", "left_anti")
    shared, links = shared_entries(distinct_docs, plan, reps, links)
    tested, comp, turn, last = None, links_to_components(links), 0, False
    while True:
        shared = unsettled(shared, comp)
        if shared.isEmpty():
            break
        last = last or turn == ROUNDS
        pairs = across(shared, reps) if last else proposals(shared)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = cut_lineage(linked(near_enough(pairs, reps), distinct_docs))
        none = new.isEmpty()
        if not none:
            links = links.unionByName(new)
            comp = links_to_components(links)
        if last:
            break
        last, turn = none, turn + 1  # nothing proposed was linked: check what is left
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(comp, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
