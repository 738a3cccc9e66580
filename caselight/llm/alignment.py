"""Alignment of two tokenizers' tokens over the same bytes, a block of texts at a time, and counts of the pairs that overlap.

Tasks tokenise: the ids of both tokenizers for each distinct word of a block, the byte offsets where their tokens end (as if
the words followed each other), and each text as numbers of words. Words begin with spaces where both tokenizers part
anyway, so texts are sequences of words for both, and words are aligned once for each block, by arrays: between two
neighbouring ends of either side lies one part of one token of A and of one of B, which is the link of the two; the ends
that both share close groups. Counting the pairs of all texts and holding each text against the counts is Spark's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, folder, ship
from .bpe import _spread as spread
from .chunks import release, tidy_batches
from .sentence_pieces import model
from .words import blocks, buffer

#: Fixed value: how byte-level tokenizers of this kind split a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes whose distinct words are aligned together.
BLOCK_BYTES = 2_000_000
#: Pairs of ids whose counts are sent to all executors: the most frequent ones. Those of all others are joined by a shuffle.
MOST_SENT = 1_000_000
#: Bytes of a row group of the links: a task's heap holds one until it is written.
GROUP_BYTES = 16_000_000

_INTS = T.ArrayType(T.IntegerType(), False)
_DOC = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.IntegerType(), False) for c in ("n_a", "n_b")], T.StructField("words", _INTS, False)])
_BLOCKS = T.StructType([T.StructField("docs", T.ArrayType(_DOC, False), False), *[T.StructField(c, _INTS, False) for c in ("a_ids", "a_ends", "b_ids", "b_ends", "word_ends")]])


def _byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@lru_cache(maxsize=2)
def byte_level(description: str) -> tuple[tiktoken.Encoding, pa.Array]:
    """The encoding that a byte-level BPE description means, special tokens being plain text, and the tokens' bytes by id.

    Raises unless ids follow the merges, so that the smallest id is the first merge.
    """
    about = json.loads(description)
    core, split = about["model"], about.get("pre_tokenizer") or {}
    if about.get("normalizer") or core.get("type") != "BPE" or core.get("ignore_merges") or core.get("dropout") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("a plain byte-level BPE is needed")
    special = {t["content"] for t in about.get("added_tokens", ())}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in piece): i for piece, i in core["vocab"].items() if piece not in special}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in core["merges"]]
    made = [core["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made[:-1], made[1:], strict=True)) or len(made) + 256 != len(ranks):
        raise ValueError("ids don't follow the merges")
    table = [b""] * (max(core["vocab"].values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), pa.array(table, pa.large_binary())


def _words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, each from its spaces on, and the texts' offsets among them.

    A word begins at a text's begin and at a space behind a character that surely is no white space.
    """
    joined = b"".join(texts)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    raw = np.frombuffer(joined, np.uint8)
    opens = np.zeros(len(raw) + 1, bool)
    opens[at] = True
    if len(raw) > 2:
        last, before = raw[1:-1], raw[:-2]
        # White space beyond ASCII ends with these bytes, behind these ones.
        blank = (last == 32) | ((last >= 9) & (last <= 13)) | np.isin(last, [0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]) & np.isin(before, [0xC2, 0x80, 0x81, 0x9A])
        opens[2:-1] |= (raw[2:] == 32) & ~blank
    starts = np.flatnonzero(opens[:-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(joined)])
    return words, np.searchsorted(starts, at, "left")


def _encode_words(encoding: tiktoken.Encoding, widths: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words in UTF-8 and the words' offsets among them. Words follow each other as in a text, but for those that end with white space, which are texts of their own."""
    raw, at = buffer(words)
    apart = np.zeros(len(at) + 1, bool)
    if len(words):
        odd = [w.decode()[-1:].isspace() for w in words.to_pylist()]
        apart[1:-1] = odd
        apart[:-2] |= odd
    step = np.arange(len(at)) % 1000 == 0
    cuts = np.unique(np.r_[at[apart[:-1] | step], at[-1]])
    text = raw.tobytes()
    parts = [np.zeros(0, np.uint32)] + [encoding.encode_to_numpy(text[u:v].decode()) for u, v in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    ids = np.concatenate(parts).astype(np.int32)
    return ids, np.searchsorted(np.concatenate(([0], np.cumsum(widths[ids]))), at)


def _spelled(table: pa.Array, ids: np.ndarray, at: np.ndarray, letters: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Which words' ids have the words' own bytes."""
    got, starts = buffer(table.take(pa.array(ids)))
    starts = starts[at]
    same = np.diff(starts) == np.diff(to)
    size = np.where(same, np.diff(to), 0)
    other = got[spread(starts[:-1], size)] != letters[spread(to[:-1], size)]
    return same & (np.bincount(np.repeat(np.arange(len(size)), size)[other], minlength=len(size)) == 0)


def _widths(table: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(table.buffers()[1], np.int64)[: len(table) + 1])


def _tokeniser(description: str, raw: bytes, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes blocks of tokens from batches (id, text)."""
    ints = pa.int32()

    def block(names: pa.Array, part: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        a, a_bytes = byte_level(description)
        b = model(raw)
        texts = [b" " + part[u:v].tobytes() if v > u else b"" for u, v in zip(offsets[:-1], offsets[1:], strict=True)]
        words, at = _words(texts)
        words = words.dictionary_encode()
        which, distinct = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        letters, word_to = buffer(distinct)
        try:
            letters.tobytes().decode()
        except UnicodeDecodeError:
            distinct = pa.array([w.decode("utf-8", "replace").encode() for w in distinct.to_pylist()], pa.large_binary())
        a_ids, a_at = _encode_words(a, _widths(a_bytes), distinct)
        b_ids, b_at = b.encode_words(distinct)
        fine = _spelled(a_bytes, a_ids, a_at, letters, word_to) & _spelled(b.bytes, b_ids, b_at, letters, word_to)
        # Words that aren't spelled, and texts with one, go.
        bad = np.concatenate(([0], np.cumsum(~fine[which])))
        held = bad[at[1:]] == bad[at[:-1]]
        number = np.cumsum(fine) - 1
        of_word = np.repeat(held, np.diff(at))
        word_at = np.concatenate(([0], np.cumsum(np.where(held, np.diff(at), 0))))
        counted = [np.concatenate(([0], np.cumsum(np.diff(x)[which])))[at] for x in (a_at, b_at)]
        flat = []
        for table, ids, ends in ((a_bytes, a_ids, a_at), (b.bytes, b_ids, b_at)):
            ids = ids[np.repeat(fine, np.diff(ends))]
            flat += [ids, np.cumsum(_widths(table)[ids], dtype=np.int32)]
        flat.append(np.cumsum(np.diff(word_to)[fine], dtype=np.int32))
        of = pa.StructArray.from_arrays(
            [names, *(pa.array(np.where(held, np.diff(x), 0), ints) for x in counted), pa.ListArray.from_arrays(pa.array(word_at, ints), pa.array(number[which[of_word]], ints))], ["id", "n_a", "n_b", "words"]
        )
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], ints), x) for x in (of, *(pa.array(x, ints) for x in flat))]
        return pa.RecordBatch.from_arrays(lists, _BLOCKS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = buffer(batch.column(1))
            for first, end, part, offsets in blocks(data, at, block_bytes):
                yield block(batch.column(0).slice(first, end - first), part, offsets)

    return run


def _files(a_path: str, b_path: str) -> tuple[str, bytes]:
    """What describes the tokenizers; tasks get it with the function."""
    description, raw = Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()
    byte_level(description)
    model(raw)
    return description, raw


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(docs, a_ids, a_ends, b_ids, b_ends, word_ends): blocks of texts as tokens, by a byte-level BPE (A) of space and text, and by a SentencePiece model (B) that adds the space.

    Ids and ends are those of the block's distinct words, one after another; ends are byte offsets. docs has each text's id,
    its numbers of tokens and the numbers of its words. Texts that are null, empty or not spelled by both have none.
    """
    return _texts(docs, id_col, text_col).mapInArrow(tidy_batches(_tokeniser(*_files(a_path, b_path), BLOCK_BYTES)), _BLOCKS)


@lru_cache(maxsize=1)
def _decimals(size: int) -> pa.Array:
    """The numbers below size as decimal text, followed by a comma, then all by a bar, then all by a semicolon."""
    return pa.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(size)], pa.large_binary())


def _word_groups(sides: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], shared: np.ndarray, word_ends: np.ndarray) -> pa.Array:
    """Each word's groups as text, each group with a semicolon behind it. sides: ids and ends of A and of B."""
    size = 1 << max(int(ids.max(initial=0)) for ids, _ in sides).bit_length()
    upto = [np.concatenate(([0], np.searchsorted(ends, shared, "right"))) for _, ends in sides]  # tokens of the first groups
    text = np.empty(sum(len(ids) for ids, _ in sides), np.int64)
    for k, (ids, ends) in enumerate(sides):
        group = np.searchsorted(shared, ends)
        # A token stands behind the other side's tokens of the groups before, those of B also behind A's of their own group.
        text[np.arange(len(ids)) + upto[1 - k][group + k]] = ids + size * np.where(ends == shared[group], 1 + k, 0)
    letters, at = buffer(_decimals(size).take(pa.array(text)))
    word_at = np.concatenate(([0], at[sum(np.searchsorted(ends, word_ends, "right") for _, ends in sides)]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word_ends), [None, pa.py_buffer(word_at), pa.py_buffer(letters)])


def _aligner(b_bits: int, wide: bool, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes rows of texts from blocks of `tokens`: their groups as text, or its SHA-256, and their links, as 64-bit numbers if wide."""

    def aligned(docs: pa.StructArray, a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, word_ends: np.ndarray) -> pa.RecordBatch:
        ends, shared = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = a_ids[np.searchsorted(a_ends, ends)].astype(np.int64 if wide else np.int32) << b_bits | b_ids[np.searchsorted(b_ends, ends)]
        links_at, groups_at = (np.concatenate(([0], np.searchsorted(x, word_ends, "right"))) for x in (ends, shared))
        words = docs.field("words").flatten().to_numpy()
        at = np.frombuffer(docs.field("words").buffers()[1], np.int32)[docs.field("words").offset :][: len(docs) + 1]
        at = at.astype(np.int64) - (at[0] if len(at) else 0)
        n_links = np.diff(links_at)[words]
        own = lambda n: np.concatenate(([0], np.cumsum(n)))[at]
        letters, text_at = buffer(_word_groups(((a_ids, a_ends), (b_ids, b_ends)), shared, word_ends).take(pa.array(words)))
        letters, text_at = memoryview(letters), text_at[at].tolist()
        texts = (letters[u : max(u, v - 1)] for u, v in zip(text_at[:-1], text_at[1:], strict=True))  # without the last semicolon
        groups = [hashlib.sha256(x).hexdigest() if len(x) else "" for x in texts] if digest else [x.tobytes().decode() for x in texts]
        columns = [
            docs.field("id"), docs.field("n_a").cast(pa.int64()), docs.field("n_b").cast(pa.int64()), pa.array(np.diff(own(np.diff(groups_at)[words]))), pa.array(groups, pa.string()),
            pa.ListArray.from_arrays(pa.array(own(n_links), pa.int32()), pa.array(links[spread(links_at[words], n_links)])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "groups", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs, *arrays = (batch.column(c)[i].values for c in _BLOCKS.names)
                if len(docs):
                    yield aligned(docs, *(x.to_numpy() for x in arrays))
                    release()

    return run


def _aligned_row(wide: bool) -> str:
    return f"id long, n_a long, n_b long, n_groups long, groups string, links array<{'long' if wide else 'int'}>"


def align(tokens: DataFrame, b_bits: int) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups, links) for each text of the blocks: groups as `a1,a2|b1;a3|b2,b3`, and one number for each pair of tokens that overlap: A's id shifted by b_bits, and B's."""
    ship(tokens.sparkSession)
    return tokens.mapInArrow(tidy_batches(_aligner(b_bits, True, False)), _aligned_row(True))


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_sent: int = MOST_SENT) -> DataFrame:
    """One row for each input row: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Byte offsets where tokens of both end cut them into groups; two tokens are linked if their bytes overlap. An id pair's
    count is how many links have it in all texts. n_best are the links whose count is the largest that their B id has, ties
    included; count_sum is the sum of the counts over the links. groups_sha256 is the digest of the groups' text, '' for a
    row without tokens: a null or empty text, or one that the tokens don't spell (it holds U+2581). Repeated rows and null
    ids keep a row each, and count each. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    description, raw = _files(a_path, b_path)
    b_bits = max(1, (model(raw).size - 1).bit_length())
    wide = len(byte_level(description)[1]) << b_bits > 1 << 31
    tokenise, each_text = _tokeniser(description, raw, BLOCK_BYTES), _aligner(b_bits, wide, True)
    # A block goes from its tokens to its texts' rows within a task; of the groups' text only the digest leaves it.
    aligned = _texts(docs, id_col, text_col).mapInArrow(tidy_batches(lambda batches: each_text(tokenise(batches))), _aligned_row(wide))
    rows = aligned.select(F.monotonically_increasing_id().alias("row"), "id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), F.col("groups").alias("groups_sha256"), "links")
    place = folder(spark, "links")
    rows.write.option("parquet.block.size", GROUP_BYTES).parquet(place)  # texts are tokenised once; the links are read twice
    rows = spark.read.parquet(place)

    each = rows.select("row", F.explode("links").alias("pair"))
    counts = cut(each.groupBy("pair").agg(F.count("*").alias("count")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << b_bits) - 1))
    top = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # a row for each entry of B's vocabulary at most
    judged = counts.join(F.broadcast(top), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    # How many pairs have a count of 1, 2 to 3, 4 to 7 ...: from the smallest such step on they are few enough to be sent.
    steps = judged.groupBy(F.floor(F.log2("count")).cast("int").alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, held = None, 0
    for r in steps:
        held += r["n"]
        if held > most_sent:
            break
        least = r["step"]
    step = F.floor(F.log2("count")).cast("int")
    few = judged.where(step >= least) if least is not None else judged.limit(0)
    met = each.join(F.broadcast(few), "pair").groupBy("row").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    if held > most_sent:
        rare = judged.where(step < least) if least is not None else judged
        rest = each.join(F.broadcast(few.select("pair")), "pair", "left_anti").groupBy("row", "pair").agg(F.count("*").alias("times"))
        more = rest.join(rare.hint("shuffle_hash"), "pair").groupBy("row").agg(F.sum(F.col("best") * F.col("times")).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
        met = met.unionByName(more).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    out = rows.drop("links").join(met, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
