"""N-gram Jaccard self-join by chosen paths.

Each set of word shingles becomes a fixed number of minhash tokens. A run draws
tokens at random, with the same draw for all sets, and a set goes down one path
for each drawn token it holds; similar sets share paths. Paths of few sets are
compared at once, the others are split again. Runs repeat until the wanted
recall. The candidates' sets are then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.arrow import mixed
from leakscope.llm.common import components, either, once, probably_in, sealed, space_words, text_or_empty

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 128
# Drawn tokens that two sets at the threshold share per level, on average.
# Above one, so that a pair may stay together to any depth; so low that sets with
# less than about half in common thin out from level to level.
SHARED_DRAWS = 1.5
# Recall of pairs just at the threshold; that of closer pairs is higher.
RECALL = 0.9999
# Sets of a path that are compared at once. Smaller ones would split groups of like
# sets again and again, as these share most of what is drawn.
BUCKET = 2048
# Share of equal tokens from which a pair is looked at exactly: five standard
# deviations of the estimate below the threshold, for 128 tokens.
NEAR = 0.62
# With a head of a crowded path sets become candidates from some likeness on, at most
# LINKED. Those need no pairs with each other, only with sets that are not linked to
# that head: a set that is closer to it than REACH above the closest of these is within
# 0.2 of none of them. REACH is 0.2 and over three deviations of the estimates. Each
# head takes the likeness, not below LOOSE, by which the fewest sets go further, and a
# set goes further only if all HEADS of its path let it.
LINKED, LOOSE, REACH, HEADS = 0.45, 0.2, 0.36, 4
# Crowded paths left after so many splits are candidate groups as a whole; those are
# compared in bounded blocks.
LEVELS = 12
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000

_U = np.uint64


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the word shingles; a shorter text is one shingle."""
    words = words.view(np.uint64)
    size = min(size, len(words))
    if size == 0:
        return words[:0]
    total = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = mixed(total * _U(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k])
    return np.unique(total)


_FACTORS = mixed(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each of the hash functions."""
    factors, shifts = _FACTORS[:TOKENS, None] | _U(1), _FACTORS[TOKENS:, None]
    least = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (factors * shingles[None, at : at + 2048] + shifts).min(axis=1), out=least)
    return (least >> _U(32)).astype(np.uint32)


def runs_for(recall: float, shared: float = SHARED_DRAWS) -> int:
    """Runs after which a pair at the threshold has met with this probability.

    A pair stays together down to any depth if a branching process with a Poisson
    number of shared draws per level never ends; a mean above one makes that likely.
    """
    alive = 1.0
    for _ in range(100):
        alive = 1.0 - math.exp(-shared * alive)
    return max(1, math.ceil(math.log(1.0 - recall) / math.log(1.0 - alive)))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:]))


def _binary_rows(column: pa.BinaryArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), -1)


def _sketched(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sketches, lows = [], [], [], []
            for words in _lists(batch.column("words")):
                found = shingle_set(words, shingle)
                place = np.arange(1, len(found) + 1, dtype=np.uint64)
                keys.append([_fold(found, place), _fold(mixed(found), place)])
                sizes.append(len(found))
                drawn = sketch(found)
                sketches.append(drawn.tobytes())
                lows.append(drawn.astype(np.uint8).tobytes())
            both = np.array(keys, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(lows, pa.binary())],
                ["doc", "k1", "k2", "size", "sketch", "low"],
            )

    return run


def _sets(shingle: int):
    """The sets of candidate texts, of rows that carry the known set key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, sets = [], []
            keys = (batch.column(c).to_pylist() for c in ("doc", "k1"))
            for words, tid, k1 in zip(_lists(batch.column("words")), *keys):
                found = shingle_set(words, shingle)
                if _fold(found, np.arange(1, len(found) + 1, dtype=np.uint64)).view(np.int64) == k1:
                    tids.append(tid)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(sets, pa.binary())], ["tid", "shingles"])

    return run


def _fold(values: np.ndarray, place: np.ndarray) -> np.uint64:
    return np.bitwise_xor.reduce(mixed(values + place * _U(0x9E3779B97F4A7C15)), initial=_U(len(values)))


def _word_hashes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    words = docs.select(F.col(doc_id).cast("bigint").alias("doc"), space_words(F.lower(text_or_empty(text))).alias("words"))
    return words.where("doc IS NOT NULL").select("doc", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))


def _drawn(nodes: np.ndarray, sketches: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths of the tokens drawn at each row's node."""
    places = np.arange(sketches.shape[1], dtype=np.uint64) << _U(32)
    draws = mixed(mixed(places[None, :] | sketches.astype(np.uint64)) ^ nodes[:, None])
    rows, columns = np.nonzero(draws < _U(int(chance * 2**64)))
    return rows, mixed(draws[rows, columns] + _U(1))


def _first_paths(runs: int, chance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, tid = _binary_rows(batch.column("sketch"), np.uint32), batch.column("tid").to_numpy()
            for root in mixed(np.arange(1, runs + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)):
                rows, paths = _drawn(np.full(len(tid), root), sketches, chance)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(tid[rows])], ["path", "tid"])

    return run


def _next_paths(chance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                nodes, tid = batch.column("path").to_numpy().view(np.uint64), batch.column("tid").to_numpy()
                rows, paths = _drawn(nodes, _binary_rows(batch.column("sketch"), np.uint32), chance)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(tid[rows])], ["path", "tid"])

    return run


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many tokens each set of a crowded path shares with each of the path's heads."""
    for batch in batches:
        if len(batch):
            own = _binary_rows(batch.column("sketch"), np.uint32)
            steps = [(own == _binary_rows(batch.column(f"sketch{k}"), np.uint32)).sum(axis=1) for k in range(HEADS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("tid"), *(pa.array(x, pa.int32()) for x in steps)],
                ["path", "tid", *(f"step{k}" for k in range(HEADS))],
            )


def _roots(count: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Smallest member of each member's connected group."""
    up = list(range(count))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(count)]


def _linked(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group after the pairs a, b are joined."""
    while len(a):
        low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(roots, high[apart], low[apart])
        while (roots[roots] != roots).any():
            roots = roots[roots]
    return roots


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a sorted partition, one or more whole runs at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[0].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each set of a small path to the first one of its near group there."""
    for table in _groups(batches, "path"):
        table = table.combine_chunks()
        paths, tid = table["path"].to_numpy(), table["tid"].to_numpy()
        low = _binary_rows(table["low"], np.uint8)
        roots = np.arange(len(paths))
        for step in range(1, len(paths)):
            rows = np.nonzero(paths[:-step] == paths[step:])[0]
            if not len(rows):
                break
            rows = rows[roots[rows] != roots[rows + step]]  # already in one group: nothing to learn
            # Lowest bytes agree by chance in one of 256 cases.
            rows = rows[(low[rows] == low[rows + step]).mean(axis=1) >= NEAR]
            roots = _linked(roots, rows, rows + step)
        if (roots != np.arange(len(paths))).any():
            rows = np.nonzero(roots != np.arange(len(paths)))[0]
            x, y = tid[rows], tid[roots[rows]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _limits(compared: DataFrame) -> DataFrame:
    """Each crowded path's cuts and limits, one for each of its heads.

    Sets from cut on are linked to the head. The others go further, and so do linked
    ones up to limit. Of all cuts from LOOSE to LINKED, in steps of one token, the one
    that lets fewest go is taken.
    """
    counted = reduce(
        DataFrame.union,
        [
            compared.groupBy("path", F.lit(k).alias("of_head"), F.col(f"step{k}").alias("step")).agg(F.count("*").alias("n"))
            for k in range(HEADS)
        ],
    )
    reach, loose, linked = math.ceil(REACH * TOKENS), math.ceil(LOOSE * TOKENS), math.ceil(LINKED * TOKENS)
    steps = F.array_sort(F.collect_list(F.struct("step", "n")))
    heads = counted.groupBy("path", "of_head").agg(steps.alias("steps"))  # at most a row per token

    def going(cut: Column) -> Column:
        below = F.filter("steps", lambda s: s["step"] < cut)
        top = F.array_max(F.transform(below, lambda s: s["step"]))
        within = F.filter("steps", lambda s: s["step"] <= top + reach)
        n = F.aggregate(within, F.lit(0).cast("bigint"), lambda total, s: total + s["n"])
        return F.struct(F.when(top.isNull(), 0).otherwise(n).alias("n"), (-cut).alias("cut"), (top + reach).alias("limit"))

    best = once(heads.select("path", "of_head", F.array_min(F.transform(F.sequence(F.lit(loose), F.lit(linked)), going)).alias("best")), "limits")
    of = {k: F.col("of_head") == k for k in range(HEADS)}
    return best.groupBy("path").agg(
        *[F.max(F.when(of[k], -F.col("best.cut"))).alias(f"cut{k}") for k in range(HEADS)],
        *[F.max(F.when(of[k], F.col("best.limit"))).alias(f"limit{k}") for k in range(HEADS)],
    )


def _to_head(k: int) -> tuple[Column, Column]:
    return F.least("tid", f"head{k}").alias("a"), F.greatest("tid", f"head{k}").alias("b")


def _candidates(texts: DataFrame, recall: float, threshold: float) -> DataFrame:
    """Edges a, b that put every pair, up to the recall, into one connected group."""
    chance = min(1.0, SHARED_DRAWS / (threshold * TOKENS))
    sketches = texts.where("size > 0").select("tid", "sketch")
    paths = once(sketches.mapInArrow(_first_paths(runs_for(recall), chance), "path bigint, tid bigint"), "paths")
    edges, leaves = [], []
    for level in range(1, LEVELS + 1):
        heads = [F.min_by("tid", F.xxhash64("path", F.lit(k), "tid")).alias(f"head{k}") for k in range(HEADS)]
        sized = once(paths.groupBy("path").agg(F.count("*").alias("n"), *heads).where("n > 1"), "path-sizes")
        live = once(paths.join(sized, "path"), "live-paths")
        leaves.append(live.where(F.col("n") <= BUCKET).select("path", "tid"))
        crowded = live.where(F.col("n") > BUCKET)
        if crowded.isEmpty():
            break
        if level == LEVELS:
            edges.append(crowded.where("tid <> head0").select(*_to_head(0)))
            break
        if level == 1:  # later levels have only sets of these
            sketches = once(sketches.join(crowded.select("tid").distinct(), "tid"), "crowded-sketches")
        known = sized.where(F.col("n") > BUCKET).drop("n")
        for k in range(HEADS):
            known = known.join(sketches.select(F.col("tid").alias(f"head{k}"), F.col("sketch").alias(f"sketch{k}")), f"head{k}")
        known = once(known, "heads")
        schema = "path bigint, tid bigint, " + ", ".join(f"step{k} int" for k in range(HEADS))
        compared = once(
            crowded.select("path", "tid")
            .join(sketches, "tid")
            .join(known.select("path", *[f"sketch{k}" for k in range(HEADS)]), "path")
            .mapInArrow(_with_heads, schema),
            "with-heads",
        )
        limits = _limits(compared).join(known.select("path", *[f"head{k}" for k in range(HEADS)]), "path")
        placed = once(compared.join(limits, "path"), "placed")
        linked = [F.col(f"step{k}") >= F.col(f"cut{k}") for k in range(HEADS)]
        edges += [placed.where(linked[k] & (F.col("tid") != F.col(f"head{k}"))).select(*_to_head(k)) for k in range(HEADS)]
        done = [linked[k] & (F.col(f"step{k}") > F.coalesce(f"limit{k}", F.lit(-1))) for k in range(HEADS)]
        paths = once(
            placed.where(~either(done))
            .select("path", "tid")
            .join(sketches, "tid")
            .mapInArrow(_next_paths(chance), "path bigint, tid bigint"),
            "paths",
        )
    leaf_rows = reduce(DataFrame.union, leaves)
    near = (
        leaf_rows.join(texts.select("tid", "low"), "tid")
        .repartition("path")
        .sortWithinPartitions("path", "tid")
        .mapInArrow(_bucket_edges, "a bigint, b bigint")
    )
    return once(reduce(DataFrame.union, edges, near).distinct(), "candidates")


def _exact_links(threshold: float):
    """Links of each member within its task, and the first member it hangs on there.

    A task holds one whole candidate group, or one or two blocks of a large one;
    with two, only pairs across them count.
    """

    def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(sets)
        _, columns, counts = np.unique(flat, return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        useful = counts[columns] > 1
        rows, columns = rows[useful], columns[useful]
        order = np.argsort(columns, kind="stable")
        rows, columns = rows[order], columns[order]
        total = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for low in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4096):
            a, b = np.searchsorted(columns, [low, low + 4096])
            if a < b:
                part = np.zeros((len(sets), 4096), dtype=np.float32)
                part[rows[a:b], columns[a:b] - low] = 1
                total += part @ part.T
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "task"):
            tasks = table["task"].to_numpy()
            tid, side = table["tid"].to_numpy(), table["side"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in table["shingles"].to_pylist()]
            bounds = [0, *(np.nonzero(tasks[1:] != tasks[:-1])[0] + 1).tolist(), len(tasks)]
            out: list[list] = [[], [], []]
            for a, b in zip(bounds[:-1], bounds[1:]):
                sizes = np.array([len(x) for x in sets[a:b]], dtype=np.float64)
                shared = shared_counts(sets[a:b]).astype(np.float64)
                union = sizes[:, None] + sizes[None, :] - shared
                is_link = shared >= threshold * union - 1e-9
                np.fill_diagonal(is_link, False)
                if (side[a:b] > 0).any():
                    is_link &= side[a:b, None] != side[None, a:b]
                links = is_link.sum(axis=1)
                x, y = np.nonzero(np.triu(is_link))
                roots = _roots(b - a, zip(x.tolist(), y.tolist()))
                for i in np.nonzero(links)[0].tolist():
                    out[0].append(int(tid[a + i]))
                    out[1].append(int(links[i]))
                    out[2].append(int(tid[a + roots[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["tid", "links", "hangs_on"])

    return run


def _tasks(members: DataFrame, threshold: float) -> DataFrame:
    """Which sets meet in which comparison: tid, task and side.

    A group within the bounds is one task. A larger one is cut by size, as sets
    whose sizes differ more than the threshold allows cannot link, and each size
    class into blocks; every block meets itself, the later blocks of its class
    and all blocks of the next class.
    """
    step = math.log(1 / threshold) if threshold < 1 else 1.0
    classed = members.withColumn("class", F.floor(F.log(F.col("size")) / F.lit(step)).cast("int"))
    whole = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    fits = (F.col("n") <= BLOCK_SETS) & (F.col("total") <= BLOCK_SHINGLES)
    small = members.join(whole.where(fits).select("root"), "root").select(
        "tid", F.xxhash64("root").alias("task"), F.lit(0).alias("side")
    )
    large = classed.join(once(whole.where(~fits).select("root"), "large-groups"), "root")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    counted = once(large.groupBy("root", "class").agg(blocks.alias("blocks")), "blocks")
    other = counted.select(F.col("root").alias("other_root"), F.col("class").alias("other"), F.col("blocks").alias("other_blocks"))
    placed = large.join(counted, ["root", "class"]).withColumn(
        "block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    )
    met = placed.join(other, F.expr("root = other_root AND abs(class - other) <= 1"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    own, theirs = F.struct("class", "block"), F.struct(F.col("other").alias("class"), F.col("with").alias("block"))
    is_first = own <= theirs
    pair = met.select(
        "tid",
        F.xxhash64("root", F.least(own, theirs), F.greatest(own, theirs)).alias("task"),
        F.when(own == theirs, 0).when(is_first, 1).otherwise(2).alias("side"),
    )
    return small.union(pair)


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row per id: doc_id, text_id, class_id, n_links, n_rows.

    Words are lower-cased and split at white space; a text is the set of its
    shingles, one of fewer words a single shingle. ``text_id`` is the smallest id
    with an equal set, ``n_links`` the number of different sets at or above the
    threshold, ``class_id`` the smallest id that links lead to, and ``n_rows``
    the rows with this id. Links are verified exactly; of pairs just at the
    threshold the wanted recall is found, of closer ones more.

    Texts without words, null ones too, have no set: each is a class of its own
    without links. Rows without an id give no row. An id of several rows keeps
    one of their texts, the one with the smallest set key. An empty table gives
    no rows.
    """
    hashed = _word_hashes(docs, doc_id, text)
    schema = "doc bigint, k1 bigint, k2 bigint, size bigint, sketch binary, low binary"
    sketched = once(hashed.mapInArrow(_sketched(shingle), schema), "sketches")
    docs_ = once(
        sketched.groupBy("doc").agg(F.min(F.struct("k1", "k2", "size")).alias("key"), F.count("*").alias("n_rows")).select("doc", "key.*", "n_rows"),
        "docs",
    )
    firsts = docs_.where("size > 0").groupBy("k1", "k2").agg(F.min("doc").alias("text_id"))
    texts = once(
        firsts.join(sketched.where("size > 0").withColumnRenamed("doc", "text_id"), ["text_id", "k1", "k2"])
        .dropDuplicates(["text_id"])
        .select(F.col("text_id").alias("tid"), "k1", "k2", "size", "sketch", "low"),
        "texts",
    )
    candidates = components(_candidates(texts, recall, threshold), "candidates")
    members = once(
        candidates.withColumnRenamed("node", "tid").join(texts.select("tid", "k1", "k2", "size"), "tid"), "members"
    )
    candidate = probably_in(members, "tid")
    sets = (
        hashed.where(candidate(F.col("doc"))).join(members.select(F.col("tid").alias("doc"), "k1", "k2"), "doc")
        .mapInArrow(_sets(shingle), "tid bigint, shingles binary")
        .dropDuplicates(["tid"])
    )
    tasks = once(_tasks(members.select("tid", "root", "size"), threshold), "tasks")
    linked = once(
        tasks.join(sets, "tid")
        .repartition("task")
        .sortWithinPartitions("task", "tid")
        .mapInArrow(_exact_links(threshold), "tid bigint, links bigint, hangs_on bigint"),
        "links",
    )
    counts = linked.groupBy("tid").agg(F.sum("links").alias("n_links"))
    hung = linked.where("tid <> hangs_on").select(F.least("tid", "hangs_on").alias("a"), F.greatest("tid", "hangs_on").alias("b"))
    classes = components(hung.distinct(), "classes").withColumnRenamed("node", "tid")
    known = once(
        texts.select("tid", "k1", "k2").join(counts, "tid", "left").join(classes, "tid", "left"), "classes"
    )
    found = docs_.join(known, ["k1", "k2"], "left")
    text_id = F.coalesce("tid", "doc")
    return found.select(
        F.col("doc").alias("doc_id"),
        text_id.alias("text_id"),
        F.coalesce("root", text_id).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "n_rows",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents without those that link to a smaller id, with all their columns.

    Of rows that share an id and a text one stays, with the smallest row digest;
    different texts under one id all stay or all go. Rows without an id all stay.
    """
    found = near_duplicates(docs, doc_id, text, **parameters)
    kept = found.where("class_id = doc_id").select(F.col("doc_id").alias("doc"))
    rows = sealed(docs, doc=F.col(doc_id).cast("bigint"))
    body = text_or_empty(F.col("row")[text])
    named = rows.join(kept, "doc").withColumns({"h1": F.xxhash64(body), "h2": F.xxhash64(F.lit(1), body)})
    repeated = named.groupBy("doc", "h1", "h2").agg(F.min(_row_digest(docs)).alias("digest"), F.count("*").alias("n")).where("n > 1")
    marked = named.join(repeated.drop("n"), ["doc", "h1", "h2"], "left")
    single = marked.where("digest IS NULL").select("row.*")
    several = marked.where(F.col("digest") == _row_digest(docs)).dropDuplicates(["doc", "h1", "h2"]).select("row.*")
    return single.union(several).union(rows.where("doc IS NULL").select("row.*"))


def _row_digest(docs: DataFrame) -> Column:
    return F.xxhash64(F.to_json("row"))
