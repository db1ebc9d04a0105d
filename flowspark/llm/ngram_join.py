"""Size-aware Jaccard join of documents on word n-grams, and the groups that its links form.

Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of n-word shingles.

* Equal sets are one node, so copies, however many, cost one row each.
* All sets are ordered alike: shingles that whole tasks found frequent come last, the rest by hash.
  Sets that link share at least k shingles within their first ``n - ceil(t*n) + k`` (prefix).
* Light sets (below the boundary) enumerate the 2-subsets of their prefix; two light sets that link
  share a subset.  Heavy sets, and light ones that are large enough to link with a heavy one, put
  their prefix into inverted lists, with k about half the number of shingles that a linked set may
  lack; a pair with a heavy set shares as many lists as the k of its smaller set.  The boundary is the
  size at which all subsets and list entries together are estimated to cost least.
* A heavy set that shares fewer lists, with whomever, than its smallest possible partner asks for links
  with nothing and leaves before any pair is made; sets that have a few passages in common leave so.
  The others leave out one list less than that smallest partner asks for, their longest ones.
* A list or subset with many sets is not expanded into pairs: first every member is compared with
  the list's smallest node only, which then leaves the list, as all its pairs are settled; then, where
  other members are still in different components, those are joined on the list, pruned by size and by
  an exact lower bound on the difference of two sets (parity bitmaps).  Pairs already connected are skipped,
  as they cannot change a component.  Where a random slice of such pairs shows that all are more than all
  nodes of the table, slices of about half as many pairs as nodes in them are made and verified in turns, each
  after those that the turns before connect are skipped; then all that are left are made.
* Intermediate tables are counted and take the partitions that their rows need.
* Every candidate is verified on the whole texts.

Nulls and edge cases: a null or blank text has no shingles and links with nothing; fewer than n words
are one shingle; a null doc_id is never linked; repeated rows are one node and get one result each, and
rows that repeat a doc_id with another text are judged by their own text; other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import LOWER, SLICE_BYTES, Rolling, frugal, longs, mixed, narrow, slices, stored
from flowspark.llm.components import components

CELLS = 1 << 22
MAX_FREQUENT = 1 << 18
PARITY = 8
WIDE, WIDE_FROM = 128, 800  # words of the wide bitmap, and the set size from which on there is one
FIRST_LISTS = 8
MANY_PAIRS = 8  # pairs per node from which on they are verified in turns
FEW_PAIRS, TURNS = 4, 8  # pairs of a node in a turn, and turns before all that is left
COMPARED = 64  # pairs per row of the torn lists that are compared to tell how many pairs all have
SIGNED = 1024  # nodes whose signatures are made at once
MARKS = 1 << 24  # bits of the table that tells which texts have a candidate
_BIN = 1.1


@dataclass(frozen=True)
class Rule:
    """n-word shingles and the least Jaccard similarity num/den."""

    n: int = 5
    num: int = 80
    den: int = 100

    def least(self, size: np.ndarray) -> np.ndarray:
        """The least intersection of a set of this size with any partner."""
        return -(-size * self.num // self.den)

    def short(self, size: np.ndarray) -> np.ndarray:
        """The prefix in which linked sets share two shingles."""
        return np.where(size > 1, np.minimum(size, size - self.least(size) + 2), 0)

    def lists(self, size: np.ndarray) -> np.ndarray:
        """The k of a set's lists: it grows with the size, and no partner has fewer shingles in common."""
        least = self.least(size)
        return np.maximum(1, np.minimum(least, 1 + (size - least) // 2))

    def listed(self, size: np.ndarray) -> np.ndarray:
        """The prefix that goes into lists: linked sets share as many shingles there as the smaller set's ``lists``."""
        return np.where(size > 1, np.minimum(size, size - self.least(size) + self.lists(size)), 0)

    def linked(self, a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)


def _shingle_sets(column: pa.Array, n: int) -> Iterator[tuple]:
    """Per slice: first row, number of rows, and the distinct shingle hashes with their rows, sorted by row and hash."""
    for part in slices(column):
        part.data = LOWER[part.data]
        words = part.words()
        word = mixed(Rolling.of_bytes(part.data).ranges(words.starts, words.ends), 1)
        rows, first = words.windows(n)
        hashes = word[first].copy() if len(first) else np.zeros(0, np.uint64)
        for k in range(1, n):
            hashes = mixed(hashes, k) + word[first + k]
        short = np.flatnonzero((words.counts > 0) & (words.counts < n))
        if len(short):
            whole = Rolling.of(word).ranges(words.first[short], words.last[short]) + words.counts[short].astype(np.uint64)
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
        hashes = mixed(hashes, 9)
        order = np.lexsort((hashes, rows))
        rows, hashes = rows[order], hashes[order]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        yield part.first, part.rows, rows[fresh], hashes[fresh]


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def _frequent_task(n: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, np.int32)
        total = 0
        for batch in batches:
            for _, _, _, hashes in _shingle_sets(batch["text"], n):
                np.add.at(seen, _cell(hashes), 1)
                total += len(hashes)
        mean = total / CELLS
        often = np.flatnonzero(seen >= max(6, 2 * mean + 6 * mean**0.5))
        yield pa.record_batch([longs(often), longs(seen[often])], ["cell", "seen"])

    return task


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Cells of shingles that are frequent within tasks: a level per cell, 0 for all others.

    It decides on the order of shingles alone, thus on speed; any order gives the same links.  Its
    size is fixed by ``MAX_FREQUENT``.
    """
    rows = (
        docs.select("text").mapInArrow(frugal(_frequent_task(n)), "cell long, seen long")
        .groupBy("cell").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "cell").limit(MAX_FREQUENT).toArrow()
    )
    levels = np.zeros(CELLS, np.uint8)
    levels[rows["cell"].to_numpy()] = np.log2(rows["seen"].to_numpy() + 1.0).astype(np.uint8) + 1
    return levels


def _set_task(rule: Rule, levels: np.ndarray) -> Callable:
    """Rows (doc_id, key, n_shingles, node, prefix, p0..): node is a hash of the whole set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, rows, hashes in _shingle_sets(batch["text"], rule.n):
                bounds = np.searchsorted(rows, np.arange(count + 1))
                sizes = np.diff(bounds)
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(mixed(hashes, 11), out=sums[1:], dtype=np.uint64)
                node = mixed(sums[bounds[1:]] - sums[bounds[:-1]] + sizes.astype(np.uint64), 12)
                order = np.lexsort((hashes, levels[_cell(hashes)], rows))
                ordered = hashes[order]
                length = np.maximum(rule.short(sizes), rule.listed(sizes))
                starts = np.cumsum(length) - length
                take = np.arange(length.sum()) - np.repeat(starts, length) + np.repeat(bounds[:-1], length)
                prefix = pa.ListArray.from_arrays(pa.array(np.append(starts, length.sum()).astype(np.int32)), longs(ordered[take]))
                bits = np.zeros((count, PARITY), np.uint64)
                np.bitwise_xor.at(bits, (rows, (hashes & np.uint64(PARITY - 1)).astype(np.int64)), np.uint64(1) << ((hashes >> np.uint64(8)) & np.uint64(63)))
                large = sizes >= WIDE_FROM
                own = large[rows]
                wide = np.zeros((int(large.sum()), WIDE), np.uint64)
                place = (np.cumsum(large) - 1)[rows[own]]
                np.bitwise_xor.at(wide, (place, ((hashes[own] >> np.uint64(16)) & np.uint64(WIDE - 1)).astype(np.int64)), np.uint64(1) << ((hashes[own] >> np.uint64(24)) & np.uint64(63)))
                maps = iter(wide)
                yield pa.record_batch(
                    [batch["doc_id"].slice(first, count), batch["key"].slice(first, count), longs(sizes), longs(node), prefix, pa.array([next(maps).tobytes() if x else None for x in large], pa.binary()), *(longs(bits[:, i]) for i in range(PARITY))],
                    ["doc_id", "key", "n_shingles", "node", "prefix", "wide", *(f"p{i}" for i in range(PARITY))],
                )

    return task


def _boundary(nodes: DataFrame, rule: Rule) -> int:
    """The set size from which on inverted lists are used, by least estimated cost.

    Sizes are gathered into bins that grow by a tenth, so a few hundred rows reach the driver.
    """
    bins = {
        int(_BIN**b): (rows, short, entries)
        for b, rows, short, entries in nodes.where("n_shingles > 1").groupBy(F.floor(F.log("n_shingles") / np.log(_BIN)).alias("b"))
        .agg(F.count("*"), F.sum(F.expr(f"least(n_shingles, n_shingles - (n_shingles * {rule.num} + {rule.den - 1}) div {rule.den} + 2)")), F.sum(F.size("prefix"))).collect()
    }
    sizes = sorted(bins)
    total = sum(e for _, _, e in bins.values()) or 1
    mean_list = 1 + sum(r for r, _, _ in bins.values()) / total

    def cost(cut: int) -> float:
        subsets = sum(r * (p := short / r) * (p - 1) / 2 for s, (r, short, _) in bins.items() if s < cut)
        lists = sum(e * (1 + mean_list) for s, (_, _, e) in bins.items() if s >= cut * rule.num / rule.den)
        return subsets + lists

    return min((int(s) for s in [2, *sizes, (sizes[-1] * 2 if sizes else 2)]), key=cost)


def _signature_task(rule: Rule, cut: int) -> Callable:
    """Rows (sig, node, need): a node that links shares ``need`` of its signatures at least."""
    low = -(-cut * rule.num // rule.den)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SIGNED) for b in batches for k in range(0, b.num_rows, SIGNED)):
            nodes = batch["node"].to_numpy()
            sizes = batch["n_shingles"].to_numpy()
            lists = batch["prefix"]
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            length = rule.short(sizes)
            need = np.where(sizes >= cut, rule.lists(rule.least(sizes)), 1)
            out, owner = [], []
            listed = np.flatnonzero(sizes >= low)
            if len(listed):
                own = rule.listed(sizes[listed])
                take = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(bounds[:-1][listed], own)
                out.append(mixed(values[take], 21))
                owner.append(np.repeat(listed, own))
            for p in np.unique(length[(sizes < cut) & (length > 1)]):
                chosen = np.flatnonzero((sizes < cut) & (length == p))
                block = values[bounds[:-1][chosen][:, None] + np.arange(p)]
                i, j = np.triu_indices(p, 1)
                out.append(mixed(mixed(block[:, i], 22) + mixed(block[:, j], 23), 24).ravel())
                owner.append(np.repeat(chosen, len(i)))
            if out:
                rows = np.concatenate(owner)
                yield pa.record_batch([longs(np.concatenate(out)), pa.array(nodes[rows]), pa.array(need[rows].astype(np.int32))], ["sig", "node", "need"])

    return task


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch in runs of at most ``rows`` pairs and about ``SLICE_BYTES`` of text; a longer pair is a run of its own."""
    length = sum((pc.fill_null(pc.binary_length(batch[c]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("text_a", "text_b")), np.zeros(batch.num_rows, np.int64))
    ends = np.cumsum(length)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, ends[at] - length[at] + SLICE_BYTES, "right"))
        end = min(max(fit, at + 1), at + rows)
        yield batch.slice(at, end - at)
        at = end


def _verify_task(rule: Rule) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in _pieces(batch):
                sides = []
                for side in ("text_a", "text_b"):
                    own = [(rows + first, hashes) for first, _, rows, hashes in _shingle_sets(few[side], rule.n)]
                    sides.append((np.concatenate([r for r, _ in own]), np.concatenate([h for _, h in own])))
                (rows_a, a), (rows_b, b) = sides
                rows, hashes = np.concatenate([rows_a, rows_b]), np.concatenate([a, b])
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                same = (rows[1:] == rows[:-1]) & (hashes[1:] == hashes[:-1])
                count = lambda x: np.bincount(x, minlength=few.num_rows)
                linked = rule.linked(count(rows_a), count(rows_b), count(rows[1:][same]))
                yield few.select(["a", "b"]).filter(pa.array(linked))

    return task


def _may_link(rule: Rule) -> F.Column:
    """Size bound and parity bound: each bit that differs stands for a shingle that only one side has."""
    a, b = F.col("a.n_shingles"), F.col("b.n_shingles")
    apart = sum((F.bit_count(F.col(f"a.p{i}").bitwiseXOR(F.col(f"b.p{i}"))) for i in range(PARITY)), F.lit(0))
    return (F.least(a, b) * rule.den >= F.greatest(a, b) * rule.num) & (apart * (rule.den + rule.num) <= (a + b) * (rule.den - rule.num))


def _close_task(rule: Rule) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            both = np.flatnonzero(pc.and_(batch["wide_a"].is_valid(), batch["wide_b"].is_valid()).to_numpy(zero_copy_only=False))
            if len(both):
                few = batch.take(pa.array(both))
                a, b = (np.frombuffer(b"".join(few[c].to_pylist()), np.uint64).reshape(-1, WIDE) for c in ("wide_a", "wide_b"))
                apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
                total = few["n_a"].to_numpy() + few["n_b"].to_numpy()
                keep[both] = apart * (rule.den + rule.num) <= total * (rule.den - rule.num)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return task


def _close(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``pairs(a, b)`` without those of large sets whose wide bitmaps prove them apart."""
    large = nodes.where("wide IS NOT NULL")
    side = lambda x: large.select(F.col("node").alias(x), F.col("wide").alias(f"wide_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").mapInArrow(_close_task(rule), "a long, b long")


def _marked(rows: DataFrame, column: str, kept: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``kept``, before anything is shuffled; with left_anti, those rows.

    One bit per hashed value, 64 to a row: the broadcast has at most MARKS / 64 rows whatever the input.
    Many values fill it and it then lets more rows through, never fewer.
    """
    place = f"pmod(xxhash64({column}), {MARKS})"
    word, bit = F.expr(f"{place} div 64"), F.expr(f"shiftleft(1L, cast({place} % 64 AS int))")
    marks = kept.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(marks), (word == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0), how)


def _shared(rows: DataFrame) -> DataFrame:
    """(sig, nodes) of the signatures that several nodes have; a node has each of its own once."""
    return stored(rows.groupBy("sig").agg(F.count("*").alias("nodes")).where("nodes > 1"))


def _members(signatures: DataFrame) -> DataFrame:
    """(sig, node, center) of the lists by which pairs are found.

    Nodes that share fewer signatures than they need leave.  All others share as many with each node that they link with, so
    they still meet when each leaves out ``need - 1`` of its signatures by one order of all: those with the longest lists.
    """
    shared = _shared(signatures)
    rows = _marked(signatures, "sig", shared)
    if shared.count() > MARKS // 4:  # then the marks let too many through to count by
        rows = rows.join(shared, "sig", "left_semi")
    enough = stored(rows.groupBy("node").agg(F.count("*").alias("lists"), F.min("need").alias("need")).where("lists >= need").select("node"))
    rows = _marked(rows, "node", enough).join(shared, "sig")
    own = Window.partitionBy("node")
    ranked = rows.withColumns({"place": F.row_number().over(own.orderBy(F.desc("nodes"), "sig")), "lists": F.count("*").over(own)})
    rows = stored(ranked.where("lists >= need AND place >= need").select("sig", "node"))
    lists = stored(rows.groupBy("sig").agg(F.min("node").alias("center"), F.count("*").alias("nodes")).where("nodes > 1").select("sig", "center"))
    return stored(_marked(rows, "sig", lists).join(lists, "sig").select("sig", "node", "center"))


def _nodes(found: DataFrame) -> DataFrame:
    """One row per set that can link, with the ``row`` of ``found`` that stands for it; prefixes stay in ``found`` only."""
    columns = ["doc_id", "key", "n_shingles", "row", "wide", *(f"p{i}" for i in range(PARITY))]
    one = F.min_by(F.struct(*columns), "key").alias("one")  # combines before the shuffle
    rows = found.where("n_shingles > 1 AND doc_id IS NOT NULL").groupBy("node").agg(one, F.count("*").alias("copies"))
    return stored(narrow(rows, found.count()).select("node", "one.*", "copies"))


def _prefixes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, prefix) of every node once; only rows of sets that have copies are shuffled to find the one that stands for them."""
    rows = found.where("n_shingles > 1 AND doc_id IS NOT NULL").select("node", "row", "n_shingles", "prefix")
    copied = stored(nodes.where("copies > 1").select("node", "row"))
    first = _marked(rows, "node", copied).join(nodes.select("node", "row"), ["node", "row"], "left_semi")
    return _marked(rows, "node", copied, "left_anti").union(first).select("node", "n_shingles", "prefix")


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): rows with one key have the same id and text, and a repeated id with another text has another key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The links among candidate pairs (a, b); only texts of nodes in pairs are written for the joins."""
    ends = narrow(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * (count := pairs.count()))
    ids = stored(narrow(ends.join(nodes.select("node", "doc_id", "key"), "node"), 2 * count))
    own = _marked(_keyed(docs), "key", ids)
    texts = stored(own.join(ids, ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "text"))
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(frugal(_verify_task(rule)), "a long, b long")


def sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per document, written once: its set's size, node, prefix and parity bits, and a number of its own."""
    parity = ", ".join(f"p{i} long" for i in range(PARITY))
    levels = _frequent(docs, rule.n)
    found = _keyed(docs).mapInArrow(frugal(_set_task(rule, levels)), f"doc_id long, key long, n_shingles long, node long, prefix array<long>, wide binary, {parity}")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def _some(pairs: DataFrame, turn: int) -> tuple[DataFrame, bool]:
    """At most ``FEW_PAIRS`` of the pairs of every node on either side, and whether all pairs are many times the nodes."""
    by = lambda own, other: pairs.groupBy(own, F.pmod(F.xxhash64(other, F.lit(turn)), F.lit(FEW_PAIRS))).agg(F.min(other).alias(other)).select("a", "b")
    ends = pairs.agg(F.count("*").alias("pairs"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    return by("a", "b").union(by("b", "a")).distinct(), ends["pairs"] > MANY_PAIRS * (ends["a"] + ends["b"])


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select(F.col("b"), F.col("a")))


def _torn(members: DataFrame, grouped: DataFrame, rows: int) -> DataFrame:
    """(sig, node, component) of the lists whose nodes are in more than one component."""
    placed = members.join(grouped, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    torn = placed.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("sig")
    return stored(narrow(placed.join(torn, "sig", "left_semi"), rows))


def _placed(apart: DataFrame, attributes: DataFrame) -> DataFrame:
    """Rows of torn lists with their nodes' attributes and first lists."""
    low = apart.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_LISTS).alias("low"))
    return apart.join(attributes, "node").join(low, "node")


def _far(rest: DataFrame, rule: Rule, slices: int = 1, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of ``rest`` that share a list, are in different components and may link: all, or a random one in ``slices``.

    Nodes are dealt into classes, and a slice joins each class with one other (or itself), so only its own pairs are compared.
    """
    place = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(slices))
    a, b = rest.alias("a"), rest.alias("b")
    # a pair that meets on many lists is made once: not where both know a common list that comes before
    before = F.exists("a.low", lambda x: (x < F.col("a.sig")) & F.array_contains(F.col("b.low"), x))
    one = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.component") < F.col("b.component"))
    if slices > 1:
        a, b = rest.withColumn("class", place).alias("a"), rest.withColumn("class", F.pmod(-place, F.lit(slices))).alias("b")
        one &= F.col("a.class") == F.col("b.class")
    return a.join(b, one & _may_link(rule) & ~before).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def links(docs: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """Links between nodes: enough of them to give every component, each one verified.

    Those of large lists come as stars, (node, smallest node of its component).
    """
    parity = [f"p{i}" for i in range(PARITY)]
    nodes = _nodes(found)
    prefixes = _prefixes(found, nodes)
    cut = _boundary(prefixes, rule)
    members = _members(prefixes.mapInArrow(frugal(_signature_task(rule, cut)), "sig long, node long, need int"))
    attributes = nodes.select("node", "n_shingles", *parity)
    rows = members.count()

    stars = narrow(members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), rows)
    pairs = narrow(
        stars.alias("s").join(attributes.alias("a"), F.col("s.a") == F.col("a.node")).join(attributes.alias("b"), F.col("s.b") == F.col("b.node"))
        .where(_may_link(rule)).select("s.a", "s.b"), rows
    )
    pairs = stored(narrow(_close(pairs, nodes, rule), rows))
    grouped = stored(components(_verified(pairs, docs, nodes, rule)))

    members, tried, linkable = members.where("node <> center").select("sig", "node"), pairs, nodes.count()
    for turn in range(TURNS + 1):
        apart = _torn(members, grouped, rows)
        rest = stored(narrow(_placed(apart, attributes), rows))
        places, compared = apart.groupBy("sig").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n").cast("double") ** 2) / 2).first()
        slices = math.ceil(compared / (COMPARED * places)) if places else 1
        if slices == 1 or turn == TURNS:
            break
        ends, expected = rest.select("node").distinct().count(), _far(rest, rule, slices, turn).count() * slices
        if expected <= linkable:  # no more than the input, though their own nodes may be few
            break
        members = apart.select("sig", "node")  # components only grow, so no other list is torn later
        few = _far(rest, rule, min(slices, math.ceil(2 * expected / ends)), turn).join(_both(tried), ["a", "b"], "left_anti")
        few = stored(narrow(_close(few, nodes, rule), rows))
        tried = tried.union(few)
        grouped = stored(components(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_verified(few, docs, nodes, rule))))
    far = stored(_close(_far(rest, rule).join(_both(tried), ["a", "b"], "left_anti"), nodes, rule))
    known = lambda: grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for turn in range(TURNS):
        few, many = _some(far, turn)
        if not many:
            break
        grouped = stored(components(known().union(_verified(stored(few), docs, nodes, rule))))
        side = lambda x: grouped.select(F.col("node").alias(x), F.col("component").alias(f"component_{x}"))  # noqa: E731, B023
        open_ = far.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(component_a, a) <> coalesce(component_b, b)")
        far = stored(open_.join(few, ["a", "b"], "left_anti").select("a", "b"))
    return known().union(_verified(far, docs, nodes, rule))


def joined(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    found = sets(docs, rule)
    grouped = components(links(docs, found, rule))
    rows = found.count()
    by_node = found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = by_node.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("node", "component_id")
    named = narrow(named, rows)
    own = found.select("doc_id", "n_shingles", F.expr("CASE WHEN n_shingles > 0 AND doc_id IS NOT NULL THEN node END").alias("node"))
    return own.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
