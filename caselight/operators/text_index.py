"""A stored text index that changes: segments of block-coded postings, marks for what is gone, and searches that skip blocks.

Documents of a segment are numbered by their ids. The postings of a term are rows of their own for each BLOCK documents, so
that a term that all texts have is as many rows as there are blocks, in files ranged by term and block; ids are coded as
small distances from the block's first. A block row tells the best that any of its postings can score: its largest count and its smallest text. A change
writes a segment for new texts, and for texts that it replaces or removes their numbers and how often their terms occurred.
Versions are named in a log as those of `sources.store`: two that change at once follow each other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.store import TRIES, Conflict, Files
from .fulltext import B, K1, LEAST_TOKENS, query_terms, terms_of_texts

#: Documents of a block, as a power of two; blocks that a search scores first, to know what the others must reach.
BLOCK_BITS, FIRST = 10, 32
_BLOCK = "term string, block long, most_tf int, least_size int, steps array<int>, tfs array<int>, sizes array<int>"
#: Bits of a number below the task's, as those of monotonically_increasing_id.
_TASK_BITS = 33


def _blocks_of(stops: list[str] | None, least: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's texts (id, text) the block rows, and a row without a term for each block: its texts' ids, numbers and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, first = pa.null(), TaskContext.get().partitionId() << _TASK_BITS

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        def made(block: int, texts: list[tuple[object, dict[str, int]]]) -> pa.RecordBatch:
            lengths, met = [sum(t.values()) for _, t in texts], {}
            for step, (_, terms) in enumerate(texts):
                for term, tf in terms.items():
                    if (at := met.get(term)) is None:
                        at = met[term] = ([], [])
                    at[0].append(step)
                    at[1].append(tf)
            held = list(met.values())
            steps, tfs = [list(range(len(texts))), *[x for x, _ in held]], [[], *[x for _, x in held]]
            of_sizes = [lengths, *[[lengths[i] for i in x] for x, _ in held]]
            n = len(steps)
            columns = [
                pa.array([[k for k, _ in texts], *[None] * (n - 1)], pa.list_(kind)), pa.array([None, *met], pa.string()), pa.array([block] * n, pa.int64()), pa.array([max(x, default=None) for x in tfs], pa.int32()),
                pa.array([min(x) for x in of_sizes], pa.int32()), pa.array(steps, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32())), pa.array(of_sizes, pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["ids", "term", "block", "most_tf", "least_size", "steps", "tfs", "sizes"])

        block, texts = first >> bits, []
        for key, terms in terms_of_texts(seen(), stops):
            if terms and sum(terms.values()) >= least:
                texts.append((key, terms))
                if len(texts) == 1 << bits:
                    yield made(block, texts)
                    block, texts = block + 1, []
        if texts:
            yield made(block, texts)

    return run


@dataclass(frozen=True)
class State:
    """A version: segments, marks of what is gone in them, and the numbers of live texts and of their tokens."""

    number: int = -1
    segments: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()
    texts: int = 0
    tokens: int = 0


@dataclass(frozen=True)
class TextIndex:
    """The index under `root`; ids are of the column `id_col`, and texts are tokenised as those of `fulltext`."""

    spark: SparkSession
    root: str
    id_col: str
    stop_words: tuple[str, ...] | None = None
    least: int = LEAST_TOKENS
    block_bits: int = BLOCK_BITS
    read: dict[str, int] = field(default_factory=dict)

    @property
    def _stops(self) -> list[str] | None:
        return None if self.stop_words is None else list(self.stop_words)

    # --- versions -----------------------------------------------------------------------------------------------------

    def state(self) -> State:
        files = Files(self.spark, self.root)
        there = files.names(f"{self.root}/log")
        if not there:
            if "committed" in files.names(f"{self.root}/made"):
                raise RuntimeError(f"{self.root} had versions but has no log")
            return State()
        d = json.loads(files.read(f"{self.root}/log/{there[-1]}"))
        return State(**{**d, "segments": tuple(d["segments"]), "gone": tuple(d["gone"])})

    def _commit(self, state: State) -> bool:
        files = Files(self.spark, self.root)
        done = files.put(f"{self.root}/log/{state.number:020d}", json.dumps(asdict(state)))
        if done:
            files.put(f"{self.root}/made/committed", "")
        return done

    def _parts(self, names: tuple[str, ...], part: str, schema: str) -> DataFrame:
        """The rows of a part of several segments or marks, each with its folder as `segment`."""
        if not names:
            return self.spark.createDataFrame([], f"{schema}, segment string")
        each = [self.spark.read.parquet(f"{self.root}/{n}/{part}") for n in names]
        return reduce(DataFrame.unionByName, [x.withColumn("segment", F.lit(n)) if "segment" not in x.columns else x for n, x in zip(names, each, strict=True)])

    def documents(self, state: State | None = None) -> DataFrame:
        """(id, size, segment, doc): the live texts."""
        state = state or self.state()
        docs = self._parts(state.segments, "docs", f"id {self._kind()}, doc long, size int")
        return docs.join(self._parts(state.gone, "docs", "doc long"), ["segment", "doc"], "left_anti")

    def _kind(self) -> str:
        return Files(self.spark, self.root).read(f"{self.root}/made/kind")

    # --- changes ------------------------------------------------------------------------------------------------------

    def put(self, rows: DataFrame, text_col: str) -> State:
        """Adds texts, in place of those of the same ids. A text with too few tokens only removes; of rows of one id the greatest text counts; null ids are left out."""
        each = rows.where(F.col(self.id_col).isNotNull()).select(F.col(self.id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        # Dealt by ranges of ids, texts are numbered in the tasks that tokenise them, and all of a block is in one task.
        texts = each.repartitionByRange("id").groupBy("id").agg(F.max("text").alias("text")).sortWithinPartitions("id")
        files, kind = Files(self.spark, self.root), rows.schema[self.id_col].dataType.simpleString()
        files.put(f"{self.root}/made/kind", kind)
        name, draft = f"segments/{uuid.uuid4().hex}", f"{self.root}/drafts/{uuid.uuid4().hex}"
        texts.mapInArrow(_blocks_of(self._stops, self.least, self.block_bits), f"ids array<{kind}>, {_BLOCK}").write.parquet(draft)
        made = self.spark.read.parquet(draft)
        docs = made.where("term IS NULL").select("block", F.explode(F.arrays_zip("ids", "steps", "sizes")).alias("p"))
        docs.select(F.col("p.ids").alias("id"), F.col("p.sizes").alias("size"), (F.shiftleft("block", self.block_bits) + F.col("p.steps")).alias("doc")).write.parquet(f"{self.root}/{name}/docs")
        self._store(made.where("term IS NOT NULL").drop("ids"), name)
        files.remove(draft)
        return self._change(cut(each.select("id").distinct()), name)

    def remove(self, ids: DataFrame) -> State:
        """Removes the texts with these ids; ids that the index doesn't have change nothing."""
        return self._change(cut(ids.select(F.col(self.id_col).alias("id")).distinct()), None)

    def _write(self, kept: DataFrame, counts: DataFrame) -> str:
        """A segment of texts (id, size) with their terms (id, term, tf)."""
        name = f"segments/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        # Numbers follow the order of ids within each file, and blocks don't cross files.
        kept.repartitionByRange("id").sortWithinPartitions("id").select("id", "size", F.monotonically_increasing_id().alias("doc")).write.parquet(f"{path}/docs")
        each = counts.join(self.spark.read.parquet(f"{path}/docs"), "id").withColumn("block", F.shiftright("doc", self.block_bits))
        found = F.array_sort(F.collect_list(F.struct("doc", F.col("tf").cast("int").alias("tf"), "size")))  # at most a block's documents
        rows = each.groupBy("term", "block").agg(found.alias("p"), F.max("tf").cast("int").alias("most_tf"), F.min("size").alias("least_size"))
        steps = F.transform("p", lambda x: x["doc"].bitwiseAND(F.lit((1 << self.block_bits) - 1)).cast("int"))
        coded = rows.select("term", "block", "most_tf", "least_size", steps.alias("steps"), F.transform("p", lambda x: x["tf"]).alias("tfs"), F.transform("p", lambda x: x["size"]).alias("sizes"))
        self._store(coded, name)
        return name

    def _store(self, coded: DataFrame, name: str) -> None:
        """A segment's blocks and how many texts have each term."""
        path = f"{self.root}/{name}"
        coded.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
        self.spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("steps")).alias("df")).write.parquet(f"{path}/terms")

    def _postings(self, blocks: DataFrame) -> DataFrame:
        """(segment, block, term, doc, tf, size) of block rows."""
        each = blocks.select("segment", "block", "term", F.explode(F.arrays_zip("steps", "tfs", "sizes")).alias("p"))
        return each.select("segment", "block", "term", (F.shiftleft("block", self.block_bits) + F.col("p.steps")).alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.sizes").alias("size"))

    def _change(self, ids: DataFrame, segment: str | None) -> State:
        for _ in range(TRIES):
            old = self.state()
            made, gone = old, None
            if old.segments:
                name = f"gone/{uuid.uuid4().hex}"
                lost = cut(self.documents(old).join(ids, "id", "left_semi").select("segment", "doc", "size"))
                count = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
                if count["n"]:
                    gone = name
                    lost.select("segment", "doc").write.parquet(f"{self.root}/{name}/docs")
                    # Their terms are read from the blocks that they are in.
                    where = lost.select("segment", F.shiftright("doc", self.block_bits).alias("block")).distinct()
                    near = self._blocks(old).join(where, ["segment", "block"], "left_semi")
                    minus = self._postings(near).join(lost.select("segment", "doc"), ["segment", "doc"], "left_semi").groupBy("term").agg(F.count("*").alias("df"))
                    minus.write.parquet(f"{self.root}/{name}/terms")
                    made = State(old.number, old.segments, (*old.gone, gone), old.texts - count["n"], old.tokens - count["tokens"])
            if segment:
                new = self.spark.read.parquet(f"{self.root}/{segment}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens")).first()
                made = State(made.number, (*made.segments, segment), made.gone, made.texts + new["n"], made.tokens + new["tokens"])
            if made == old:
                return old
            made = State(old.number + 1, made.segments, made.gone, made.texts, made.tokens)
            if self._commit(made):
                return made
        raise Conflict(f"{self.root}: {TRIES} commits were late")

    def compact(self) -> State:
        """One segment of all live texts, from what the segments hold; the texts themselves aren't needed."""
        for _ in range(TRIES):
            old = self.state()
            docs = cut(self.documents(old))
            counts = self._postings(self._blocks(old)).join(docs.select("segment", "doc", "id"), ["segment", "doc"]).select("id", "term", "tf")
            segment = self._write(docs.select("id", "size"), counts)
            made = State(old.number + 1, (segment,), (), old.texts, old.tokens)
            if self._commit(made):
                return made
        raise Conflict(f"{self.root}: {TRIES} commits were late")

    # --- searches -----------------------------------------------------------------------------------------------------

    def _blocks(self, state: State) -> DataFrame:
        return self._parts(state.segments, "blocks", _BLOCK)

    def frequencies(self, state: State | None = None) -> DataFrame:
        """(term, df): in how many live texts each term is."""
        state = state or self.state()
        plus, minus = self._parts(state.segments, "terms", "term string, df long"), self._parts(state.gone, "terms", "term string, df long")
        both = plus.select("term", "df").unionByName(minus.select("term", (-F.col("df")).alias("df")))
        return both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, query: str, k: int = 10) -> DataFrame:
        """(id_col, score): the k texts with the best BM25 scores, to four places, ties by id; the same as those of an index built afresh.

        The FIRST blocks with the best sums of bounds are scored; then only those blocks whose bounds reach the k-th score
        found. `read` tells how many blocks of the query's terms there were and how many were scored.
        """
        state = self.state()
        if not state.segments or not state.texts:
            self.read.update(blocks=0, scored=0)
            kind = self._kind() if state.number >= 0 else "long"
            return self.spark.createDataFrame([], f"{self.id_col} {kind}, score double")
        asked = query_terms(self.spark, query, self._stops)
        df = self.frequencies(state).join(F.broadcast(asked), "term")  # as many rows as the query has words
        idf = F.log(1 + (state.texts - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = F.broadcast(cut(df.select("term", idf.alias("idf"), "qtf")))
        average = state.tokens / state.texts

        def part(tf: Column, size: Column) -> Column:
            return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(average))) * F.col("qtf")

        met = self._blocks(state).join(weights, "term")
        bounds = met.withColumn("bound", part(F.col("most_tf"), F.col("least_size"))).groupBy("segment", "block").agg(F.sum("bound").alias("bound"), F.count("*").alias("rows"))
        bounds = cut(bounds)  # a row for each block of documents that has a term of the query
        gone = self._parts(state.gone, "docs", "doc long").select("segment", "doc")
        docs = self._parts(state.segments, "docs", f"id {self._kind()}, doc long, size int").select("segment", "doc", "id")

        def scored(which: DataFrame) -> DataFrame:
            near = met.join(which.select("segment", "block"), ["segment", "block"], "left_semi")
            live = self._postings(near).join(gone, ["segment", "doc"], "left_anti").join(weights, "term")
            sums = live.groupBy("segment", "doc").agg(F.round(F.sum(part(F.col("tf"), F.col("size"))), 4).alias("score"))
            return sums.join(docs, ["segment", "doc"]).orderBy(F.desc("score"), "id").limit(k).select(F.col("id").alias(self.id_col), "score")

        first = bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST)
        found = [r["score"] for r in scored(first).select("score").collect()]  # k rows
        reach = min(found) - 1e-4 if len(found) == k else float("-inf")  # scores are rounded
        wanted = cut(bounds.where(F.col("bound") >= reach))
        self.read.update(blocks=bounds.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"], scored=wanted.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"])
        return scored(wanted)
