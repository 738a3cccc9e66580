"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Fingerprints of 64 bits are 8 positional bytes. Two that differ in at most 3 bits share at least 5 of them. The index
lists fingerprints under sets of four positional bytes, chosen so that any five positions contain one of the sets;
pairs that meet under a set have their shared bytes tallied, are kept at 5 or more and verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .chunks import tidy, tidy_batches
from .words import mix

SEED = 42
_STEPS = np.arange(8, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
#: Distinct fingerprints under one key that one task compares; a key with more is compared in pairs of blocks.
BLOCK = 40_000
#: A cell with more fingerprints is searched by itself, from one to those that it reaches; smaller ones go all at once.
MANY = 64
#: Keys with more than BLOCK are told from one fingerprint in so many.
SHARE = 16
#: Links that a task holds before it joins and sends them.
HELD = 500_000


def position_sets() -> list[tuple[int, ...]]:
    """Fourteen sets of four of 8 positions such that any five positions contain a set.

    Two halves of four positions; each half's six pairs fall into three ways of pairing it up. The sets are the halves,
    and a pair of one half with a pair of the other, both of the same way. Three positions of a half contain a pair of
    each way, so three and two positions contain a set, and four and one contain a half.
    """
    low, high = (0, 1, 2, 3), (4, 5, 6, 7)

    def way(half: tuple[int, ...], pair: tuple[int, ...]) -> int:
        with_first = pair if half[0] in pair else tuple(x for x in half if x not in pair)
        return half.index(with_first[1])

    return [low, high] + [a + b for a in combinations(low, 2) for b in combinations(high, 2) if way(low, a) == way(high, b)]


def fingerprint(text: bytes, shingle: int = 3, words64: int = 1) -> np.ndarray:
    """SimHash of a text's shingles (words joined by a space, A-Z in lower case), 64 bits in each of the unsigned words.

    The first word is of the shingles' XXH64; each further one is of another scrambling of it.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(words64, np.uint64)
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64 * words64, np.int64), max(1, len(words) - shingle + 1)
    for a in range(0, n, 100_000):
        part = words[a : min(n, a + 100_000) + shingle - 1]
        grams = map(b" ".join, zip(*(part[j:] for j in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((digest(x, SEED) for x in grams), np.uint64)
        wide = np.stack([hashes, *(mix(hashes + _STEPS[k]) for k in range(1, words64))], axis=1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, words64: int = 1) -> DataFrame:
    """(id, fp): a row for each row; fp is a signed long, or binary for more than 64 bits. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, words64) for x in batch.column(1).cast(pa.large_string())]
            column = pa.array([int(x[0]) for x in prints], pa.uint64()).view(pa.int64()) if words64 == 1 else pa.array([x.tobytes() for x in prints], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["id", "fp"])

    kind = "long" if words64 == 1 else "binary"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id long, fp {kind}")


def _key(fp: Column, positions: tuple[int, ...], number: int) -> Column:
    """The bytes of a long at the positions, with the set's number before them."""
    out = F.lit(number).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long")))
    return out


def _near(prints: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, least_bytes: int) -> np.ndarray:
    """Which of the pairs (i, j) share `least_bytes` positional bytes and differ in `most` bits at most."""
    differ = prints[i] ^ prints[j]
    shared = (differ.view(np.uint8).reshape(len(i), 8 * prints.shape[1]) == 0).sum(axis=1, dtype=np.int16)
    near = np.flatnonzero(shared >= least_bytes)
    return near[np.bitwise_count(differ[near]).sum(axis=1, dtype=np.int32) <= most]


def _reach(prints: np.ndarray, most: int, least_bytes: int) -> np.ndarray:
    """For each fingerprint of one cell, the index of the first one that links reach it from.

    Whatever is reached is compared with what isn't yet, so a clump of copies costs about one comparison a member.
    """
    root, left = np.arange(len(prints)), np.arange(len(prints))
    while len(left):
        first, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            now, front = front[: max(1, 500_000 // len(left))], front[max(1, 500_000 // len(left)) :]
            i, j = np.repeat(now, len(left)), np.tile(left, len(now))
            hit = np.unique(j[_near(prints, i, j, most, least_bytes)])
            root[hit] = first
            left = left[root[left] != first]
            front = np.concatenate((front, hit))
    return root


def _roots(cells: np.ndarray, prints: np.ndarray, most: int, least_bytes: int) -> np.ndarray:
    """For each of some fingerprints (rows of words), sorted by cell, the index of the first one of its cell that it is linked with, directly or through others."""
    root = np.arange(len(cells))
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    size = np.diff(edges)
    for a, n in zip(edges[:-1][size > MANY].tolist(), size[size > MANY].tolist(), strict=True):
        root[a : a + n] = a + _reach(prints[a : a + n], most, least_bytes)
    i, lag, links_a, links_b, held = np.flatnonzero(np.repeat(size <= MANY, size)), 1, [], [], 0
    while len(i):  # neighbours at a growing distance, all cells at once
        i = i[i < len(cells) - lag]
        i = i[cells[i] == cells[i + lag]]
        for part in (i[k : k + 500_000] for k in range(0, len(i), 500_000)):
            near = part[_near(prints, part, part + lag, most, least_bytes)]
            links_a.append(near)
            links_b.append(near + lag)
            held += len(near)
        if held > 1_000_000:
            root = _merge(root, np.concatenate(links_a), np.concatenate(links_b))
            links_a, links_b, held = [], [], 0
        lag += 1
    return _merge(root, np.concatenate(links_a), np.concatenate(links_b)) if held else root


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking a with b: the smaller root spreads until nothing changes."""
    while True:
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, root):
            return root
        root = new


def _meet(prints: DataFrame, postings: Callable[[DataFrame], DataFrame], most: int, least_bytes: int) -> DataFrame:
    """(a, b): links between distinct fingerprints that meet under a key of their postings (fp, key), connecting what is near; each fingerprint's link with its smallest neighbour, and those between such neighbours.

    A key with more than BLOCK fingerprints is compared in pairs of blocks, in different tasks. Which keys these are is
    told from the fingerprints of one hash in SHARE; the links don't depend on it.
    """
    wide = prints.schema["fp"].dataType.simpleString() == "binary"
    held = postings(prints)
    hot = None
    if prints.count() > BLOCK:
        share = prints.where(F.pmod(F.xxhash64("fp"), F.lit(SHARE)) == 0)
        hot = cut(postings(share).groupBy("key").agg(F.ceil(F.count("*") * SHARE / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    if hot is None or hot.isEmpty():
        held = held.select("fp", F.xxhash64("key").alias("cell"))
    else:
        held = held.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        held = held.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        held = held.select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        held = held.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    # Cells are small; tasks take them sorted, many at a time.
    # The wide ones of a cell come in order, so that a clump has the same first ones in most of its cells, and few links are distinct.
    dealt = held.repartition(F.col("cell")).sortWithinPartitions("cell", *(["fp"] if wide else []))

    def rows_of(column: pa.Array) -> np.ndarray:
        if wide:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]

    def column_of(prints: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes() for x in prints], pa.binary()) if wide else pa.array(prints[:, 0].view(np.int64), pa.int64())

    def links_of(cells: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = _roots(cells, prints, most, least_bytes)
        moved = np.flatnonzero((root != np.arange(len(root))) & (prints[root] != prints).any(axis=1))
        return prints[root[moved]], prints[moved]

    def joined(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        # The cells of a task together: one link for each fingerprint, to the smallest that it reaches in any of them.
        a, b = (np.ascontiguousarray(np.concatenate(x)) for x in zip(*found, strict=True))
        every, at = np.unique(np.concatenate((a, b)).view(f"V{8 * a.shape[1]}").ravel(), return_inverse=True)
        root = _merge(np.arange(len(every)), at[: len(a)], at[len(a) :])
        every = every.view(np.uint64).reshape(-1, a.shape[1])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([column_of(every[root[moved]]), column_of(every[moved])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def settled(part: tuple[np.ndarray, np.ndarray]) -> bool:
            if len(part[0]):
                found.append(part)
            return sum(len(x) for x, _ in found) > HELD

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, prints = batch.column(1).to_numpy(zero_copy_only=False), rows_of(batch.column(0))
            last = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if last or (held and held[-1][0][-1] != cells[0]):
                held.append((cells[:last], prints[:last]))
                if settled(links_of(*(np.concatenate(x) for x in zip(*held, strict=True)))):
                    yield joined(found)
                    found.clear()
                held = []
            held.append((cells[last:], prints[last:]))
        if held:
            settled(links_of(*(np.concatenate(x) for x in zip(*held, strict=True))))
        if found:
            yield joined(found)

    kind = "binary" if wide else "long"
    found = dealt.select("fp", "cell").mapInArrow(tidy_batches(run), f"a {kind}, b {kind}")
    # Tasks name different roots for one fingerprint. It is linked with the smallest alone, and that with the others, which are few.
    least = found.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    each = least.select("least", F.explode(F.array("b", "a")).alias("b")).where("b <> least")
    return each.select(F.col("least").alias("a"), "b").distinct()


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links that connect the same distinct 64-bit fingerprints (column fp) as all pairs with at most `most` differing bits."""
    if most > 3:
        raise ValueError("the index guarantees five shared bytes for up to 3 differing bits")
    keys = F.array(*[_key(F.col("fp"), s, i) for i, s in enumerate(position_sets())])
    return _meet(prints, lambda rows: rows.select("fp", F.explode(keys).alias("key")), most, 8 - most)


#: 64-bit words of a fingerprint for a similarity of shingle sets, and positions in a group.
WIDE, GROUP = 4, 8


def most_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints up to which texts are candidates: those expected at the similarity and three standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    n = 64 * WIDE
    return int(n * p + 3 * np.sqrt(n * p * (1 - p)))


def _wide_postings(prints: DataFrame) -> DataFrame:
    """(fp, key): each wide fingerprint under all pairs of positional bytes within each group of positions.

    Similar texts share about a quarter of all bytes, so two in some group, but for one pair of texts in a hundred.
    """
    pairs = np.array([(g + i, g + j) for g in range(0, 8 * WIDE, GROUP) for i, j in combinations(range(GROUP), 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                rows = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(part.num_rows, -1).astype(np.int64)
                keys = np.arange(len(pairs)) * 65536 + rows[:, pairs[:, 0]] * 256 + rows[:, pairs[:, 1]]
                at = pa.array(np.repeat(np.arange(len(rows)), len(pairs)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(keys.ravel())], ["fp", "key"])

    return prints.select("fp").mapInArrow(run, "fp binary, key long")


#: A clump is compared in pairs of blocks of about so many shingles and texts at most.
BLOCK_SHINGLES, BLOCK_TEXTS = 3_000_000, 10_000


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles (see `fingerprint`); empty for a blank text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[j:] for j in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in grams), np.uint64))


def set_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Wide SimHash of a set of shingles: how often a text repeats one doesn't matter, as it doesn't for the similarity."""
    counts = np.zeros(64 * WIDE, np.int64)
    for part in (hashes[a : a + 100_000] for a in range(0, len(hashes), 100_000)):
        wide = np.stack([part, *(mix(part + _STEPS[k]) for k in range(1, WIDE))], axis=1)
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def _shingle_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_code, code, n, fp): for each row the hash of its text, the digest and number of its shingles and their wide fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes, prints = [], [], []
            for x in batch.column(2).cast(pa.large_string()):
                found = shingle_set(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)
                codes.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                prints.append(set_fingerprint(found).tobytes())
            columns = [pa.array(codes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "text_code", "code", "n", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_code"), text.alias("text")).mapInArrow(tidy_batches(run), "id long, text_code long, code binary, n long, fp binary")


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of some sets, the index of the first one that links of an exact Jaccard similarity of `similarity` or more reach it from.

    Two such sets share one of their rarest elements: all but `similarity` of a set, and one more. Only sets that do are compared.
    """
    size = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    if not size.sum():
        return root
    node = np.repeat(np.arange(len(sets)), size)
    _, value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    by_times = np.empty(len(times), np.int64)
    by_times[np.argsort(times, kind="stable")] = np.arange(len(times))
    value = by_times[value]
    value = value[np.lexsort((value, node))]
    times = np.sort(times)
    begin = np.concatenate(([0], np.cumsum(size)))
    first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    rare = np.flatnonzero((np.arange(len(value)) - begin[node] < first[node]) & (times[value] > 1))
    key, owner = value[rare], node[rare]
    rare_at = np.searchsorted(owner, np.arange(len(sets) + 1))
    marks = np.zeros(len(times), bool)
    free = np.ones(len(sets), bool)
    waste = 0
    for start in np.unique(owner).tolist():
        if not free[start]:
            continue
        free[start], front = False, [start]
        while front:
            now = front.pop()
            waste += 1
            if waste > 64:  # what is reached already leaves the list
                left = free[owner]
                key, owner, waste = key[left], owner[left], 0
            mine = value[rare[rare_at[now] : rare_at[now + 1]]]
            marks[mine] = True
            may = np.unique(owner[marks[key]])
            marks[mine] = False
            may = may[free[may] & (size[may] >= similarity * size[now] - 1e-9) & (size[now] >= similarity * size[may] - 1e-9)]
            if not len(may):
                continue
            mine = value[begin[now] : begin[now + 1]]
            marks[mine] = True
            at = np.repeat(begin[may] - np.cumsum(size[may]) + size[may], size[may]) + np.arange(size[may].sum())
            shared = np.add.reduceat(marks[value[at]].astype(np.int64), np.cumsum(size[may]) - size[may])
            marks[mine] = False
            hit = may[shared >= similarity * (size[now] + size[may] - shared) - 1e-9]
            free[hit], root[hit] = False, start
            front += hit.tolist()
    return root


def _checked(docs: DataFrame, sets: DataFrame, labels: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between sets (codes) whose exact Jaccard similarity is `similarity` or more and whose fingerprints the labels (node, label) put in one clump.

    Each set goes to its clump once, or once for each block of a large one, and every pair of a clump is looked at in some task.
    """
    named = sets.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    clumps = named.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where("m > 1")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_TEXTS)).cast("int")
    wanted = named.select("label", "code", "text_code").join(clumps.select("label", blocks.alias("blocks")), "label")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(text).alias("text_code"), text.alias("text")).dropDuplicates(["text_code"])
    held = wanted.join(texts, "text_code").withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    held = held.select("label", "own", "code", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select("label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "code", "text")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("code")
        codes = table.column("code").to_pylist()
        sets = [shingle_set((x.as_py() or "").encode(), shingle) for x in table.column("text")]
        root = alike(sets, similarity)
        moved = np.flatnonzero(root != np.arange(len(root))).tolist()
        return pa.table({"a": pa.array([codes[root[i]] for i in moved], pa.binary()), "b": pa.array([codes[i] for i in moved], pa.binary())})

    return held.groupBy("label", "low", "high").applyInArrow(tidy(compare), "a binary, b binary").distinct()


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_code, label): for each row its id, xxhash64 of its text and the label of its component, as `similar_documents` links them."""
    rows = cut(_shingle_rows(docs, id_col, text_col, shingle))
    sets = cut(rows.groupBy("code", "fp").agg(F.min("text_code").alias("text_code"), F.min("n").alias("n")))
    clumps = components(_meet(cut(sets.select("fp").distinct()), _wide_postings, most_bits(similarity), 2))
    labels = components(_checked(docs, sets, clumps, text_col, shingle, similarity))
    named = rows.join(labels.withColumnRenamed("node", "code"), "code", "left")
    return named.select("id", "text_code", F.coalesce("label", "code").alias("label"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id): like near_duplicates, for texts whose sets of shingles have a Jaccard similarity of `similarity` or more.

    64-bit fingerprints within 3 bits are far more alike than that, so fingerprints have 256 bits here. They only find
    clumps of candidates; a link stands if the exact similarity of the two sets does.
    """
    rows = cut(similar_rows(docs, id_col, text_col, shingle, similarity))
    smallest = rows.groupBy("label").agg(F.min("id").alias("component_id"))
    return rows.join(smallest, "label").select(F.col("id").alias(id_col), "component_id")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the links (a, b), the smallest node that can be reached; rounds of the smallest neighbour and of shortcuts, each written to the shared folder."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("a", "b"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        step = cut(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")))
        labels = step.select("node", "label")
        if step.where("label < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """One row for each input row: id_col, fp (signed long), component_id.

    Fingerprints link at `most` or fewer differing bits. component_id is the smallest id that links reach, the row's own
    included; null ids don't count, and a component of null ids alone has a null. Blank and null texts have fingerprint
    0, linked like any other. Other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("first")))
    return _classes(rows, prints, components(links(prints, most))).select(F.col("id").alias(id_col), "fp", "component_id")


def _classes(rows: DataFrame, prints: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with component_id: the smallest id among the fingerprints that share a label; a fingerprint without links is its own label."""
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(smallest, "label").select("fp", "component_id"), "fp")
