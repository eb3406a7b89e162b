"""N-gram Jaccard join by chosen paths: links between documents whose word shingles resemble each other.

1. ``described``: each text becomes a set of shingle hashes; equal sets share a
   128-bit name and are one *set* from here on, so copies are never paired. A
   set is mapped to ``MARKS`` MinHashes: two sets agree at a place with a
   probability that equals their similarity.
2. ``leaves``: the chosen-path recursion. A run draws places, each with
   probability 1 / (threshold * MARKS), and puts the sets into buckets by place
   and MinHash there. A bucket of more than ``LEAF`` sets draws places of its
   own and is split again, to ``DEPTH`` levels. Runs are repeated until a pair
   at the threshold is in a common leaf with probability ``recall`` (``runs_for``;
   more similar pairs do better).
3. Leaves are compared by brute force in tiles of bounded size: a leaf too
   similar to be split further is cut into blocks of at most ``LEAF`` sets and
   ``WEIGHT`` shingles on average, and each pair of blocks is a tile. A pair
   belongs to the first of the leaves that both sets lie in, so it
   is counted once, however many leaves repeat it. First, signatures of one byte
   a place leave the pairs that can reach the threshold; then the texts of the
   sets that have such a pair are brought to the tile, and the shingle sets
   are compared exactly, ``_ROWS`` rows against the others at a time.
4. Tiles return a row for each set, its number of links and the smallest set of
   its component there. ``components`` joins these into classes.

No pair is a row of any table, and no collection of sets reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.columns import row
from logtide.llm.components import stars
from logtide.llm.hashing import mixed, shingle_hashes, word_hashes
from logtide.llm.joins import near_keys, slot
from logtide.llm.order import ordered_ids
from logtide.llm.store import cut, drop

SHINGLE = 5
THRESHOLD = 0.8
MARKS = 64
LEAF = 4096
WEIGHT = 1 << 22
DEPTH = 3
RECALL = 0.999
_SLICE = 512
_ROWS = 256
_COLUMNS = 2048
_FACTORS = mixed(np.arange(1, MARKS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: Iterable[str | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, ascending."""
    for _, words in word_hashes(texts):
        yield np.unique(shingle_hashes(words, shingle))


def set_name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """``MARKS`` MinHashes as 32-bit numbers."""
    least = np.full(MARKS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, at : at + 4096] * _FACTORS[:, None]).min(1), out=least)
    return mixed(least).astype(np.uint32)


def _key() -> Column:
    return F.xxhash64("doc_id", "text").alias("key")


def described(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key (hash of doc_id and text), name (of the shingle set, null without words), weight (its size), marks (array<int>), signature (one byte a place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                names, weights, marks = [], [], np.zeros((part.num_rows, MARKS), np.uint32)
                for i, s in enumerate(shingle_sets([x.as_py() for x in part.column(1)], shingle)):
                    weights.append(len(s))
                    names.append(set_name(s) if len(s) else None)
                    if len(s):
                        marks[i] = min_hashes(s)
                lists = pa.ListArray.from_arrays(np.arange(0, marks.size + 1, MARKS, dtype=np.int32), pa.array(marks.view(np.int32).ravel()))
                signatures = pa.array([row.tobytes() for row in marks.astype(np.uint8)], pa.binary())
                cols = [part.column(0), part.column(2), pa.array(names, pa.binary()), pa.array(weights, pa.int64()), lists, signatures]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "name", "weight", "marks", "signature"])

    return docs.select("doc_id", "text", _key()).mapInArrow(run, "doc_id long, key long, name binary, weight long, marks array<int>, signature binary")


def runs_for(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met: at each level its path goes on with 1 - exp(-chance below)."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - math.exp(-chance)
    return math.ceil(math.log(1 - recall) / math.log(1 - chance))


def _drawn(seed: int, runs: int, threshold: float) -> list[tuple[int, int]]:
    """(run, place) drawn at the root of each run."""
    rng = np.random.default_rng(seed)
    return [(r, i) for r in range(runs) for i in np.flatnonzero(rng.random(MARKS) < 1 / (threshold * MARKS)).tolist()]


def _sized(members: DataFrame, name: str) -> DataFrame:
    """Members (leaf, no) of buckets that hold two sets or more, with the number of sets."""
    sizes = members.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")
    return cut(members.join(sizes, "leaf"), name)


def leaves(sets: DataFrame, threshold: float, recall: float, seed: int = 11) -> DataFrame:
    """leaf, no, blocks: the leaves of all runs, each distinct group of sets once, and the blocks to cut each into."""
    drawn = _drawn(seed, runs_for(recall, DEPTH), threshold)
    roots = ", ".join(f"struct({r}, {i}, marks[{i}])" for r, i in drawn)
    members = sets.selectExpr("no", f"inline(array({roots})) AS (run, place, mark)").selectExpr("xxhash64(run, place, mark) AS leaf", "no")
    members = _sized(members, "level1")
    small, found = None, members
    odds = int(2**30 / (threshold * MARKS))
    for level in range(2, DEPTH + 1):
        large = members.filter(F.col("size") > LEAF)
        if large.isEmpty():
            break
        leaf = members.filter(F.col("size") <= LEAF)
        small = leaf if small is None else small.unionAll(leaf)
        places = f"filter(sequence(0, {MARKS - 1}), i -> pmod(xxhash64(leaf, i), {2**30}) < {odds})"
        split = large.join(sets.select("no", "marks"), "no").selectExpr("no", "leaf", "marks", f"explode({places}) AS place")
        members = _sized(split.selectExpr("xxhash64(leaf, place, marks[place]) AS leaf", "no").distinct(), f"level{level}")
        found = small.unionAll(members)
    # Near copies meet in most runs: leaves of the same sets are one.
    same = found.groupBy("leaf").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("no")).alias("a"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "no"), 24)).alias("b"), F.min("no").alias("c"), F.max("no").alias("d")
    )
    one = same.groupBy("n", "a", "b", "c", "d").agg(F.min("leaf").alias("leaf")).select("leaf")
    found = found.join(one, "leaf").join(sets.select("no", "weight"), "no")
    weights = found.groupBy("leaf").agg(F.sum("weight").alias("weight"))
    blocks = F.ceil(F.greatest(F.col("size") / LEAF, F.col("weight") / WEIGHT)).alias("blocks")
    return cut(found.select("leaf", "no", "size").join(weights, "leaf").select("leaf", "no", blocks), "leaves")


def _tiles(members: DataFrame) -> DataFrame:
    """Members with block, a, b: each pair of blocks of a leaf is a tile."""
    t = members.withColumn("block", F.pmod(F.xxhash64("no", "leaf"), "blocks"))
    t = t.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return t.withColumn("a", F.least("block", "_other")).withColumn("b", F.greatest("block", "_other")).drop("_other", "blocks")


def _by_tile(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "leaf", "a", "b").sortWithinPartitions("leaf", "a", "b", "no")


def _tile_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one tile after the other (sorted input); tiles that go over a batch's end are put together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(n).to_numpy() for n in ("leaf", "a", "b")])
        if rest:
            last = rest[-1]
            if any(last.column(n)[-1].as_py() != keys[i][0] for i, n in enumerate(("leaf", "a", "b"))):
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
        edges = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)
        for start, end in zip(edges, np.append(edges[1:], batch.num_rows)):
            part = batch.slice(start, end - start)
            if end < batch.num_rows:
                yield pa.Table.from_batches([*rest, part]).combine_chunks().to_batches()[0] if rest else part
                rest = []
            else:
                rest.append(part)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def least_matches(threshold: float) -> int:
    """Equal signature bytes that a pair at the threshold has with all but 1 in 100,000: 4.2 standard deviations below the mean."""
    return max(1, math.floor(MARKS * threshold - 4.2 * math.sqrt(MARKS * threshold * (1 - threshold))))


def _sides(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows to compare with which, and whether they are the same ones."""
    block = tile.column("block").to_numpy()
    a, b = tile.column("a")[0].as_py(), tile.column("b")[0].as_py()
    return np.flatnonzero(block == a), np.flatnonzero(block == b), a == b


def _earlier(tile: pa.RecordBatch) -> np.ndarray:
    """Row x leaf: which earlier leaves the rows lie in, of those that two rows or more do."""
    leaf, lists = tile.column("leaf")[0].as_py(), tile.column("leaves")
    at = np.repeat(np.arange(tile.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    early = flat < leaf
    names, column, count = np.unique(flat[early], return_inverse=True, return_counts=True)
    place, some = np.cumsum(count > 1) - 1, count[column] > 1
    held = np.zeros((tile.num_rows, int((count > 1).sum())), np.float32)
    held[at[early][some], place[column[some]]] = 1
    return held


def _candidates(tile: pa.RecordBatch, matches: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): pairs of the tile's rows that may reach the threshold and meet in no earlier leaf, some rows i at a time; each pair once."""
    left, right, same = _sides(tile)
    if not len(left) or not len(right):
        return
    signatures = np.frombuffer(b"".join(tile.column("signature").to_pylist()), np.uint8).reshape(-1, MARKS)
    held = _earlier(tile)
    columns = np.ascontiguousarray(signatures[right].T)
    for start in range(0, len(left), _ROWS):
        rows = left[start : start + _ROWS]
        equal = np.zeros((len(rows), len(right)), np.uint8)
        for p in range(MARKS):
            equal += signatures[rows, p][:, None] == columns[p][None, :]
        good = equal >= matches
        if same:
            good = np.triu(good, start + 1)
        if held.shape[1] and good.any():
            good &= held[rows] @ held[right].T < 0.5
        i, j = np.nonzero(good)
        if len(i):
            yield rows[i], right[j]


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of the left with those of the right rows."""
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    some = count[column] > 1  # a shingle of one set is in no intersection
    place, owner = (np.cumsum(count > 1) - 1)[column[some]], owner[some]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((count > 1).sum()), _COLUMNS):
        lo, hi = np.searchsorted(place, [at, at + _COLUMNS])
        m = np.zeros((len(sets), _COLUMNS), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        total += m[left] @ m[right].T
    return total


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the first row of its component, after the links (i, j)."""
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        for side in (i, j):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(tile: pa.RecordBatch, sets: list[np.ndarray], matches: int, ratio: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of links, first row of its component) of each row; a link is a similarity of ratio[0] / ratio[1] or more."""
    n = tile.num_rows
    count, label, sizes = np.zeros(n, np.int64), np.arange(n), np.array([len(s) for s in sets])
    left, right, _ = _sides(tile)
    place_left, place_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    total = None
    for i, j in _candidates(tile, matches):
        if total is None and len(i) > 4 * n:
            total = _overlaps(sets, left, right)
        if total is None:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
        else:
            shared = total[place_left[i], place_right[j]].astype(np.int64)
        good = shared * ratio[1] >= (sizes[i] + sizes[j] - shared) * ratio[0]
        i, j = i[good], j[good]
        if len(i):
            count += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            label = _joined(label, i, j)
    return count, label


def _mapped(rows: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``each`` over the tiles of ``rows``; results are put together before they go back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for tile in _tile_runs(batches):
            got = each(tile)
            if got is not None and got.num_rows:
                out.append(got)
                size += got.num_rows
            if size >= 4096:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, size = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return _by_tile(rows).mapInArrow(run, schema)


def links(docs: DataFrame, sets: DataFrame, threshold: float, recall: float, shingle: int) -> DataFrame:
    """no, links, low: for each set and tile the links found there and the smallest set of its component there."""
    ratio = threshold.as_integer_ratio() if threshold not in (0.8, 0.9) else (round(threshold * 10), 10)
    matches = least_matches(threshold)
    members = leaves(sets, threshold, recall)
    lists = members.groupBy("no").agg(F.collect_list("leaf").alias("leaves"))
    tiles = _tiles(members).join(lists, "no").join(sets.select("no", "signature", "key"), "no")
    tiles = tiles.select("leaf", "a", "b", "block", "no", "key", "signature", "leaves")

    def with_candidates(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        some = np.zeros(tile.num_rows, bool)
        for i, j in _candidates(tile, matches):
            some[i] = some[j] = True
        return tile.take(pa.array(np.flatnonzero(some))) if some.any() else None

    some = cut(_mapped(tiles, with_candidates, tiles.schema), "candidates")
    # One text of each key, however many rows repeat it.
    texts = near_keys(docs.select(_key(), "text"), "key", some, "key")
    texts = texts.join(some.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    some = some.join(texts, "key").join(sets.select("no", "name"), "no")

    def verified(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(shingle_sets((x.as_py() for x in tile.column("text")), shingle))
        # Another text under the same doc_id, or a repeated row, is not the set meant.
        names, nos = tile.column("name").to_pylist(), tile.column("no").to_pylist()
        keep = [k for k, s in enumerate(found) if set_name(s) == names[k] and (k == 0 or nos[k] != nos[k - 1] or set_name(found[k - 1]) != names[k])]
        if len(keep) < len(found):
            tile, found, nos = tile.take(pa.array(keep, pa.int64())), [found[k] for k in keep], [nos[k] for k in keep]
        if not found:
            return None
        count, low = _linked(tile.drop_columns(["text"]), found, matches, ratio)
        rows, no = np.flatnonzero(count), np.array(nos)  # rows are in the order of no
        return pa.RecordBatch.from_arrays([pa.array(no[rows]), pa.array(count[rows]), pa.array(no[low[rows]])], names=["no", "links", "low"])

    columns = ["leaf", "a", "b", "block", "no", "name", "signature", "leaves", "text"]
    out = cut(_mapped(some.select(*columns), verified, "no long, links long, low long"), "links")
    drop(members)
    return out


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, null_ids: bool = False) -> DataFrame:
    """doc_id, class_id, links, copies: one row for each row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of ``shingle``
    words in a row (fewer words are one shingle) is ``threshold`` or more.
    ``class_id`` is the smallest doc_id that the document reaches over links,
    ``links`` the number of other shingle sets it is linked with, ``copies`` the
    number of rows with its own set. Null, empty and blank texts have no
    shingles: they are their own class with no links. Rows with a null doc_id
    take part like the others if ``null_ids`` is set, as the last ids (class_id
    is null where all rows of a class have none); else they take no part
    (class_id null). Repeated rows are copies; rows that share a doc_id with
    another text each have their own class. Other columns are not read; an
    empty table gives none.
    """
    out = _described_classes(docs, threshold, shingle, recall, null_ids)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def _described_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, null_ids: bool = False) -> DataFrame:
    """doc_id, key, name, class_id, links, copies, first: the rows of ``described`` with their classes (null, with the name, for rows that take no part).

    ``first`` is the key of the class's first row: the smallest key under the
    smallest doc_id of the set that names the class.
    """
    rows = cut(described(docs, shingle), "described")
    if not null_ids:
        rows = rows.withColumn("name", F.when(F.col("doc_id").isNotNull(), F.col("name")))
    known = rows.filter("name IS NOT NULL")
    sets = known.groupBy("name").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"), F.count("*").alias("copies"), F.first("weight").alias("weight"), F.first("marks").alias("marks"), F.first("signature").alias("signature"))
    sets = sets.select("name", "least.doc_id", "least.key", "copies", "weight", "marks", "signature")
    sets = ordered_ids(sets, [F.col("doc_id").asc_nulls_last(), F.col("name")], "no")
    found = links(docs, sets, threshold, recall, shingle)
    per_set = found.groupBy("no").agg(F.sum("links").alias("links"))
    star = stars(found.select(F.col("no").alias("u"), F.col("low").alias("v")))
    roots = star.join(sets.select(F.col("no").alias("v"), F.struct("doc_id", "key").alias("root")), "v").select(F.col("u").alias("no"), "root")
    classes = sets.select("name", "no", F.struct("doc_id", "key").alias("own"), "copies").join(per_set, "no", "left").join(roots, "no", "left")
    classes = classes.withColumn("root", F.coalesce("root", "own"))
    classes = classes.select("name", F.col("root.doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), "copies", F.col("root.key").alias("first"))
    return rows.select("doc_id", "key", "name").join(classes, "name", "left")


def keep_one_text(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class does, whatever doc_ids the texts share.

    A class keeps the row that names it: the smallest doc_id of its texts (null
    last), under that the text of the set that comes first. Different texts that
    share a doc_id are rows of their own; equal rows (same doc_id and text) are
    one. Rows with a null doc_id all stay unless ``null_ids`` is set. Rows
    without words have no text to tell them apart: one of each doc_id stays, and
    all that have none. Columns of any name come back as they are.

    Only rows near those that go or are repeated (in their slot) are shuffled;
    the others are kept where they are read.
    """
    t = _described_classes(docs, **options)
    groups = t.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("key") == F.col("first"), F.lit(False))).alias("named"), F.max(F.col("name").isNull()).alias("blank"))
    groups = cut(groups, "groups")
    blank = groups.filter("blank AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("key").alias("least"))
    groups = groups.join(blank, "doc_id", "left")
    loose = F.col("blank") & F.col("doc_id").isNull()
    groups = groups.withColumn("keep", F.col("named") | F.coalesce(F.col("key") == F.col("least"), F.lit(False)))
    odd = cut(groups.filter(~loose & (~F.col("keep") | (F.col("n") > 1))).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "keep"), "odd")
    taken = odd.select(slot(F.col("_key")).alias("_slot")).distinct()  # a bounded number of slots
    rows = docs.select("doc_id", _key(), row(docs).alias("_row")).withColumn("_own", slot(F.col("key")))
    rows = rows.join(F.broadcast(taken), F.col("_own") == F.col("_slot"), "left")
    plain = rows.filter("_slot IS NULL").select("_row.*")
    near = rows.filter("_slot IS NOT NULL").select("doc_id", "key", "_row")
    near = near.join(odd.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    single = near.filter("keep IS NULL").select("_row.*")
    once = near.filter("keep").dropDuplicates(["doc_id", "key"]).select("_row.*")
    return plain.unionAll(single).unionAll(once)
