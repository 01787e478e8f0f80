"""N-gram Jaccard join by parity sketches.

Every text is a set of hashed word shingles.  In a band of set sizes, a set of s and one of t
shingles whose Jaccard similarity reaches num/den differ in at most D = (s+t)(den-num)/(den+num) shingles.
A shingle is XORed into one of the blocks of a sketch, so two sketches differ in at most as many blocks as
their sets in shingles, and by the pigeonhole principle sketches of more than D blocks have an equal one.  Its
hash is a bucket key.  Blocks without shingles are no keys, unless a set has so many that all equal blocks could be such.

Equal keys form buckets.  A bucket is not expanded into pairs: its members meet its leader, the one found
in most buckets; a second parity sketch, of SKETCH bits, whose Hamming distance is also at most the sets' difference,
screens the pairs, and the sets themselves verify them.  Members that links have not joined meet again in
buckets of their rarest shingles (prefix filter): of two linked sets, the rarest shingle that both have is among the n(den-num)/den + 1
rarest of either.  Those that one text alone has are no keys: texts that share a common passage and differ elsewhere meet no
more, so the pairs made don't grow with the square of a passage's texts.  A text gives these keys once, in however many buckets it is
left over and whoever leads them, so their number grows with the texts alone.

What then is still together goes on by differences from leaders.  Two members can only link
if these overlap: |A^B| = |dA| + |dB| - 2|dA & dB|.  So they meet in buckets of the first D+1 elements of dA, those the leader
lacks, the rarer first, before those it has.  This repeats until every bucket lies within one component or is
spent.  Nothing is capped: each pair that could link is verified, or is known to be in one component.

Texts with equal sets are one node.  What is moved: 16 bytes a key once; of nodes in any bucket the packed text,
from which the set is made again where it is needed.

Defined results: null text and text without words have no
shingles and link with nothing, component_id is then the row's own id; rows that share an id
keep their own component; a null id is passed over for the smallest id.  Texts of any length are taken whole;
ties of leaders go to the larger node.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstats.llm.graph import components
from gridstats.llm.shared import discard, unused, written
from gridstats.llm.shingles import U, chunks, mix, sets_of


#: Bits of the sketch by which pairs are screened.
SKETCH = 512
#: The longs of that sketch.
WORDS = tuple(f"s{i}" for i in range(SKETCH // 64))
#: Leaders of a bucket at each level are so many times those at the level before.
FEW = 36
#: Sets of any size that can be held have a band.
LARGEST = 1 << 40


@dataclass(frozen=True)
class Spec:
    """Words a shingle; similarity num/den."""

    words: int = 5
    num: int = 80
    den: int = 100

    def apart(self, s: int) -> int:
        """Largest symmetric difference of linked sets with s elements together."""
        return s * (self.den - self.num) // (self.den + self.num)

    def partner(self, n: int) -> int:
        """Largest set that can link with one of n."""
        return n * self.den // self.num


@lru_cache(maxsize=8)
def bands(spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By band: smallest size, largest partner of its sets, blocks of a sketch, blocks that may differ.

    A set links within its band or the next.  Blocks are as few as leave twice the empty ones expected of the smallest sets.
    """
    starts, far, blocks, differ = [1], [], [], []
    while starts[-1] <= LARGEST:
        starts.append(spec.partner(starts[-1]) + 1)
        small = starts[-1] - 1
        d = spec.apart(small + spec.partner(small))
        b = d + 1
        while 2 * b * math.exp(-starts[-2] / b) >= b - d:
            b += 1 + b // 128
        far.append(spec.partner(small))
        blocks.append(b)
        differ.append(d)
    return np.array(starts[:-1]), np.array(far), np.array(blocks), np.array(differ)


def sketch_keys(sizes: np.ndarray, values: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(set number, bucket key) of non-empty sets, given one after the other: in their own band and the one below."""
    starts, far, blocks, differ = bands(spec)
    band = np.searchsorted(starts, sizes, side="right") - 1
    spot, token = mix(values + U(0x51ED270B)) >> U(32), mix(values ^ U(0x2545F4914F6CDD1D))
    stop = np.cumsum(sizes)
    of, keys = [], []
    for below in (0, 1):
        p = band - below
        use = np.flatnonzero((p >= 0) & (sizes <= far[np.maximum(p, 0)]))
        if not len(use):
            continue
        p, n = p[use], sizes[use]
        if len(use) == len(sizes):
            x, t = spot, token
        else:
            at = np.arange(int(n.sum())) + np.repeat(stop[use] - n - (np.cumsum(n) - n), n)
            x, t = spot[at], token[at]
        b = blocks[p]
        first = np.cumsum(b) - b
        place = np.repeat(first, n) + (x * np.repeat(b, n).astype(U) >> U(32)).astype(np.int64)
        sketch = np.zeros(int(b.sum()), U)
        np.bitwise_xor.at(sketch, place, t)
        filled = np.bincount(place, minlength=len(sketch)) > 0
        owner = np.repeat(np.arange(len(use)), b)
        empty = b - np.add.reduceat(filled.astype(np.int64), first)
        kept = filled | (empty >= b - differ[p])[owner]
        within = (np.arange(len(sketch)) - first[owner]).astype(U)
        keys.append(mix(sketch + mix(within + (p[owner].astype(U) << U(32))))[kept])
        of.append(use[owner[kept]])
    return np.concatenate(of), np.concatenate(keys).view(np.int64)


def bit_sketches(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Parity sketches of SKETCH bits, as rows of longs."""
    n = len(sizes)
    flips = np.bincount(np.repeat(np.arange(n), sizes) * SKETCH + (mix(values) % U(SKETCH)).astype(np.int64), minlength=n * SKETCH) & 1
    return np.packbits(flips.astype(np.uint8).reshape(-1, SKETCH), axis=1).view(">i8").astype(np.int64)


def _given(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    # Ids travel as text, so that a null among them changes no value.
    return docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))


def _chunked(batches: Iterator[pd.DataFrame], words: int) -> Iterator[tuple[pd.DataFrame, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, texts, sizes, nodes, values) in stretches of bounded size."""
    for pdf in batches:
        texts = [b"" if x is None else x.encode("utf-8", "surrogatepass").lower() for x in pdf["text"]]
        for lo, hi in chunks(texts):
            sizes, sig, values = sets_of(texts[lo:hi], words)
            yield pdf.iloc[lo:hi], texts[lo:hi], sizes, sig.view(np.int64), values


def sized_nodes(docs: DataFrame, spec: Spec, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, n_shingles, node): th is the text's hash, node that of its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, sizes, nodes, _ in _chunked(batches, spec.words):
            yield pd.DataFrame({"doc_id": part["doc_id"], "th": part["th"], "n_shingles": sizes.astype(np.int64), "node": nodes})

    out = _given(docs, doc_id, text).mapInPandas(run, "doc_id string, th long, n_shingles long, node long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _buckets(docs: DataFrame, spec: Spec, text: str) -> DataFrame:
    """(key, node) of keys that more than one node has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # of this task's texts: copies give their keys once
        for _, _, sizes, nodes, values in _chunked(batches, spec.words):
            new = np.zeros(len(sizes), bool)
            for k, node in enumerate(nodes.tolist()):
                if sizes[k] and node not in seen:
                    seen.add(node)
                    new[k] = True
            if new.any():
                of, keys = sketch_keys(sizes[new], values[np.repeat(new, sizes)], spec)
                yield pd.DataFrame({"key": keys, "node": nodes[new][of]})

    keyed = docs.select(F.col(text).alias("text")).mapInPandas(run, "key long, node long")
    spark = docs.sparkSession
    parts = max(12, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # One exchange: the rows of a key, once there, tell whether it has several nodes.
    same = Window.partitionBy("key")
    held = keyed.repartition(parts, "key").withColumn("_a", F.min("node").over(same)).withColumn("_b", F.max("node").over(same))
    return held.where("_a <> _b").select("key", "node").distinct()


def _bodies(docs: DataFrame, spec: Spec, text: str, weights: DataFrame) -> DataFrame:
    """(node, n, s0, s1, ..., body, weight) of the nodes in weights: size, bit sketch and packed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        press = zstandard.ZstdCompressor(level=3)
        for _, texts, sizes, nodes, values in _chunked(batches, spec.words):
            bits = bit_sketches(sizes, values)
            new = []
            for k, node in enumerate(nodes.tolist()):
                if sizes[k] and node not in seen:
                    seen.add(node)
                    new.append(k)
            if new:
                yield pd.DataFrame({"node": nodes[new], "n": sizes[new].astype(np.int64), **{c: bits[new, i] for i, c in enumerate(WORDS)}, "body": [press.compress(texts[k]) for k in new]})

    all_ = docs.select(F.col(text).alias("text")).mapInPandas(run, "node long, n long, " + "".join(f"{c} long, " for c in WORDS) + "body binary")
    # Merge joins at every size: a table that is broadcast when it is small would hide what the exchange costs.
    return all_.hint("merge").join(weights, "node").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *WORDS, "body", "weight")])


class _Sets:
    """Sets made again from packed texts; the leader's is kept while it stays the same."""

    def __init__(self, spec: Spec) -> None:
        self.words, self.open, self.last, self.lead = spec.words, zstandard.ZstdDecompressor(), None, None

    def of(self, body: bytes) -> np.ndarray:
        return sets_of([self.open.decompress(body)], self.words)[2]

    def leader(self, name: int, body: bytes) -> np.ndarray:
        if name != self.last:
            self.last, self.lead = name, self.of(body)
        return self.lead


def _with_bodies(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs(leader, node, ...) with the packed texts of both, own and lead; rows of a leader come together."""
    own = pairs.hint("merge").join(held.select("node", F.col("body").alias("own")), "node")
    return own.hint("merge").join(held.select(F.col("node").alias("leader"), F.col("body").alias("lead")), "leader")


def _verified(pairs: DataFrame, held: DataFrame, spec: Spec) -> DataFrame:
    """The pairs(leader, node) that link, exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets(spec)
        for pdf in batches:
            linked = []
            for name, own, lead in zip(pdf["leader"], pdf["own"], pdf["lead"], strict=True):
                a, b = sets.of(own), sets.leader(name, lead)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(spec.den * common >= spec.num * (len(a) + len(b) - common))
            yield pdf.loc[linked, ["leader", "node"]]

    return _with_bodies(pairs, held).select("leader", "node", "own", "lead").mapInPandas(run, "leader long, node long")


def _outside(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of x that are not in the sorted among."""
    if not len(among):
        return x
    return x[among[np.minimum(np.searchsorted(among, x), len(among) - 1)] != x]


def _common(held: DataFrame, spec: Spec) -> DataFrame:
    """(node, common): the shingles that another of the nodes has too, the rarer first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = _Sets(spec)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                found = [sets.of(body) for body in part["body"]]
                yield pd.DataFrame({"x": np.concatenate(found).view(np.int64), "node": np.repeat(part["node"].to_numpy(), [len(d) for d in found])})

    rows = held.select("node", "body").mapInPandas(run, "x long, node long")
    # One exchange, as in _buckets: the rows of a shingle, once there, tell how many nodes have it.
    counted = rows.withColumn("many", F.count("*").over(Window.partitionBy("x"))).where("many > 1")
    return counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "x")))["x"].alias("common"))


def _rarest(nodes: DataFrame, held: DataFrame, common: DataFrame, spec: Spec) -> DataFrame:
    """nodes(node, comp) -> (key, node, comp): the rarest shingles of a node, that must be indexed.

    Those that no other node has are the rarest, and counted, but are no keys.  A text of n shingles has at least n num/den in common
    with one linked with it, and the order is the same for all, so the n(den-num)/den rarest and one more hold the first of these.
    """
    few = F.floor(F.col("n") * (spec.den - spec.num) / spec.den) + 1
    keys = F.greatest(F.lit(0), few - (F.col("n") - F.size("common"))).cast("int")
    sized = nodes.hint("merge").join(held.select("node", "n"), "node").hint("merge").join(common, "node")
    return sized.select(F.explode(F.slice("common", F.lit(1), keys)).alias("key"), "node", "comp")


def _prefixes(members: DataFrame, held: DataFrame, common: DataFrame, spec: Spec) -> DataFrame:
    """members(leader, node, comp) -> (key, node, comp): the elements of the difference that must be indexed.

    Those that the leader lacks come first, the rarer before the others; those that no other node has are counted, but are no keys.
    Then those that it has, in order of value.  A text of n shingles has at most n(den-num)/den that one linked with it
    lacks, so where the leader lacks more, one more than these will do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, none = _Sets(spec), np.zeros(0, U)
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                found = []
                for name, own, lead, mine in zip(part["leader"], part["own"], part["lead"], part["common"], strict=True):
                    a, b = sets.of(own), sets.leader(name, lead)
                    new = len(_outside(a, b))
                    few = len(a) * (spec.den - spec.num) // spec.den
                    k = (few if new > few else spec.apart(len(a) + spec.partner(len(a)))) + 1
                    shared = _outside(none if mine is None else mine.view(U), b)
                    keys = [shared[: max(0, k - (new - len(shared)))]]
                    if new < k:
                        keys.append(_outside(b, a)[: k - new])
                    found.append(np.concatenate(keys).view(np.int64))
                n = [len(d) for d in found]
                yield pd.DataFrame({
                    "leader": np.repeat(part["leader"].to_numpy(), n), "x": np.concatenate(found),
                    "node": np.repeat(part["node"].to_numpy(), n), "comp": np.repeat(part["comp"].to_numpy(), n),
                })

    both = _with_bodies(members.hint("merge").join(common, "node", "left"), held)
    rows = both.select("leader", "node", "comp", "own", "lead", "common").mapInPandas(run, "leader long, x long, node long, comp long")
    return rows.select(F.xxhash64("leader", "x").alias("key"), "node", "comp")


def _open(rows: DataFrame) -> DataFrame:
    """Keys whose rows lie in more than one component."""
    return rows.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")


def _in_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows with the component of their node: the node itself, if it has no links."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _may_link(spec: Spec) -> Column:
    """Sizes and sketches of node and leader don't already tell that they are too far apart."""
    bits = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"lead_{c}"))) for c in WORDS))
    room = F.floor((F.col("n") + F.col("lead_n")) * (spec.den - spec.num) / (spec.den + spec.num))
    return (F.least("n", "lead_n") * spec.den >= F.greatest("n", "lead_n") * spec.num) & (bits <= room)


def link_classes(docs: DataFrame, spec: Spec, text: str) -> DataFrame | None:
    """(node, comp) for nodes with a link; comp is one of the nodes.

    The order of leaders is fixed once: by buckets, then node.  A bucket's first leaders (one, then FEW in buckets of the
    rarest shingles, then FEW squared in those of differences, and so on) meet the members after them that lie in other components: sketches screen the
    pairs, sets verify them.  The rest meets again by its rarest shingles, later the rest of a bucket by its difference from the first leader,
    which comes before all of them; so leaders of buckets within buckets descend, more of them lead at each level, and two nodes that
    stay together meet in the end.
    """
    first = written(_buckets(docs, spec, text), "buckets")
    weights = first.groupBy("node").agg(F.count("*").alias("weight"))
    held = written(_bodies(docs, spec, text, weights), "nodes")
    rank = held.select("node", "weight", "n", *WORDS)
    buckets, links, comps, common, few = first, None, None, None, 1
    while True:
        weighed = written(_in_components(buckets.join(rank, "node"), comps), "weighed")
        discard(buckets)
        buckets = weighed
        ranked = Window.partitionBy("key").orderBy(F.desc("weight"), F.desc("node"))
        leads = written(
            buckets.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= few)
            .select("key", "place", F.col("node").alias("leader"), *[F.col(c).alias(f"lead_{c}") for c in ("weight", "comp", "n", *WORDS)]), "leaders",
        )
        after = (F.col("weight") < F.col("lead_weight")) | ((F.col("weight") == F.col("lead_weight")) & (F.col("node") < F.col("leader")))
        met = buckets.join(leads, "key").where(after & (F.col("comp") != F.col("lead_comp")) & _may_link(spec))
        pairs = written(met.select("leader", "node").distinct(), "pairs")
        new = written(_verified(pairs, held, spec).select(F.col("leader").alias("a"), F.col("node").alias("b")), "links")
        discard(pairs)
        if links is None or new.limit(1).count():
            links = new if links is None else links.union(new)
            discard(comps)
            comps = components(links)
        # Members after the last leader, in buckets that still hold several components.
        last = leads.where(F.col("place") == few).select("key", F.col("leader").alias("_n"), F.col("lead_weight").alias("_w"))
        beyond = (F.col("weight") < F.col("_w")) | ((F.col("weight") == F.col("_w")) & (F.col("node") < F.col("_n")))
        rest = written(_in_components(buckets.join(last, "key").where(beyond).select("key", "node"), comps), "rest")
        top = leads.where("place = 1").select("key", "leader")
        still = written(rest.join(_open(rest), "key", "left_semi").join(top, "key").select("leader", "node", "comp").distinct(), "still")
        discard(rest, buckets, leads)
        if still.limit(1).count() == 0:
            discard(still, held, common)
            return comps
        # Most links are known now.  Buckets of common passages and of looser copies, which stay large, are left at once.
        if common is None:
            common = written(_common(held, spec), "common")
            prefix = written(_rarest(still.select("node", "comp").distinct(), held, common, spec), "prefixes")
        else:
            prefix = written(_prefixes(still, held, common, spec), "prefixes")
        buckets = written(prefix.join(_open(prefix), "key", "left_semi").select("key", "node"), "open")
        discard(still, prefix)
        few *= FEW


def keep_one(docs: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the copies: of each component the smallest id stays (of equal ids the smallest text hash).

    Texts without words stay all; of rows that repeat id and text one stays.
    """
    rows = written(jaccard_components(docs, spec, doc_id, text, with_hash=True), "components")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    best = rows.where("comp IS NOT NULL").groupBy("comp").agg(F.min(place).alias("best")).select("best.doc_id", "best.th")
    stay = written(best.union(rows.where("comp IS NULL").select("doc_id", "th").distinct()), "stay").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")
    )
    mine = unused(docs, "h")
    hashed = docs.withColumn(mine, F.xxhash64(F.col(text)))
    kept = hashed.join(stay, hashed[doc_id].eqNullSafe(stay["_id"]) & (hashed[mine] == stay["_th"]), "left_semi")
    return kept.dropDuplicates([doc_id, mine]).drop(mine)


def jaccard_components(docs: DataFrame, spec: Spec, doc_id: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id linked, itself included); with_hash adds th and comp."""
    sets = written(sized_nodes(docs, spec, doc_id, text), "shingles")
    comps = link_classes(docs, spec, text)
    least = sets.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = written(least.join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")), "classes")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = named.join(smallest, "comp").select("node", "comp", "component_id")
    rows = sets.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = rows.join(of, "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", *(["th", "comp"] if with_hash else []))
