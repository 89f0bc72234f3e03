"""Token counts of flat, unindexed token files, found from their end-of-document ids.

A token file is nothing but little-endian ids of fixed width; each document ends with the id
`end`. Files are read in blocks of equal size by byte range, so one file is shared by many
tasks. In a block the separators are found by one vectorised comparison. A block passes on how
many separators it has and how many tokens follow its last one; a prefix scan over the blocks of
a file turns these into the number of documents and the open tokens before each block, which
completes the documents that cross blocks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from spindlewatch.session import scratch_path, stage

END = 50256  # free in the vocabulary
HEAD = 5  # tokens that spell a document's id, base 50,000
DIGIT = 50_000
BLOCK_BYTES = 4 << 20
WIDTHS = {2: "<u2", 4: "<u4"}
# Characters with the property White_Space; runs from this length on are cut out of a text.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_BLANKS = re.compile(f"(?<!{BLANK}){BLANK}{{1024,}}")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """Byte-pair encoder of a public vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(code, text: str) -> list[int]:
    """Token ids of a whole text, at any length of its runs of white space.

    The word pattern takes all of such a run but its last character as one piece, by looking ahead from
    each of its places, and the matcher runs out of room in runs near a million. Long runs are cut out
    here by the same rule (all of the run where the text ends with it) and encoded as the pieces they are.
    """
    ids, start = [], 0
    for run in LONG_BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += code.encode_ordinary(text[start:run.start()])
        ids += code._encode_single_piece(text[run.start():end].encode())
        start = end
    return ids + code.encode_ordinary(text[start:])


def _digits(doc_id: int | None) -> list[int]:
    """The id as HEAD tokens, the first of which tells sign and null; none is the end id."""
    if doc_id is None:
        return [2, 0, 0, 0, 0]
    left, out = abs(doc_id), []
    for _ in range(HEAD - 1):
        left, digit = divmod(left, DIGIT)
        out.append(digit)
    return [left * 3 + (doc_id < 0), *out[::-1]]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, pattern: str,
                 doc_id: str = "doc_id", text: str = "text") -> None:
    """Write flat files of 2-byte ids: for each row the id's HEAD tokens, the text's tokens, END.

    Spark's text writer puts down each document's bytes and, as line separator, the two bytes of
    END: files are committed like any other output, and a lost task is simply run again. Null and
    empty texts have no token of their own. Texts of any length are encoded whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode_text(code, t.as_py() or "")
                rows.append(np.array(_digits(d) + ids, "<u2").tobytes())
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    (docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "value binary")
     .select(F.col("value").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", END.to_bytes(2, "little").decode("latin-1"))
     .text(path))


def scan_tokens(spark: SparkSession, path: str, end: int = END, width: int = 2, head: int = 0,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, head): every document of the flat files below `path`.

    start is the document's first token in its file, n_tokens excludes the separator, `head`
    holds up to that many of its first tokens. A file that does not end with a separator has a
    last document without one, if any token is left. Two separators in a row delimit an empty
    document. Empty files hold none. A byte short of a whole token at a file's end is ignored.
    """
    block = block_bytes // width * width
    tokens = block // width
    if head > tokens:
        raise ValueError("a block must hold a document's head")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", (F.col("length") - F.col("length") % width).alias("length"))
             .filter("length > 0"))
    blocks = (files.withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block).cast("long"))))
        .repartition(F.col("path"), F.col("block")))
    pieces = blocks.mapInArrow(_scanner(block, width, end, head), """
        path string, block long, is_last boolean, seps long, tail long, size long,
        first array<long>, open array<long>, at array<long>, heads array<array<long>>""")
    pieces = stage(pieces, "token-blocks")  # read for whole documents and for borders
    order = W.partitionBy("path").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    none = F.array().cast("array<long>")
    borders = (
        pieces.select("path", "block", "is_last", "seps", "tail", "size", "first", "open",
                      F.get("at", F.lit(0)).alias("stop"))
        .withColumn("ordinal", F.coalesce(F.sum("seps").over(before), F.lit(0)))
        .withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
        # Where the document after the block's last separator begins, and its first tokens,
        # which may lie in the next block.
        .withColumn("since", F.when(F.col("seps") > 0, F.col("base") + F.col("size") - F.col("tail")))
        .withColumn("opened", F.when(F.col("seps") > 0, F.concat(
            "open", F.coalesce(F.lead("first").over(order), none))))
        # The same for the document that is open at the block's start.
        .withColumn("began", F.coalesce(F.max("since").over(before), F.lit(0)))
        .withColumn("carried", F.coalesce(F.last("opened", True).over(before),
                                          F.first("first").over(order))))
    inner = (pieces.filter("seps > 1").join(borders.select("path", "block", "ordinal", "base"), ["path", "block"])
             .select("path", "ordinal", "base", "at", F.posexplode("heads").alias("k", "head"))
             .select(F.col("path").alias("file"), (F.col("ordinal") + 1 + F.col("k")).alias("ordinal"),
                     (F.col("base") + F.col("at")[F.col("k")] + 1).alias("start"),
                     (F.col("at")[F.col("k") + 1] - F.col("at")[F.col("k")] - 1).alias("n_tokens"),
                     "head"))
    closing = (borders.filter("seps > 0")
               .select(F.col("path").alias("file"), "ordinal", F.col("began").alias("start"),
                       (F.col("base") + F.col("stop") - F.col("began")).alias("n_tokens"),
                       F.col("carried").alias("head")))
    last = (borders.filter("is_last")
            .select(F.col("path").alias("file"), (F.col("ordinal") + F.col("seps")).alias("ordinal"),
                    F.coalesce("since", "began").alias("start"),
                    (F.col("base") + F.col("size") - F.coalesce("since", "began")).alias("n_tokens"),
                    F.coalesce("opened", "carried").alias("head"))
            .filter("n_tokens > 0"))
    cut = F.slice("head", F.lit(1), F.least(F.col("n_tokens"), F.lit(head)).cast("int"))
    return inner.union(closing).union(last).withColumn("head", cut)


def _scanner(block: int, width: int, end: int, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = pafs.FileSystem.from_uri(row["path"])
                start = row["block"] * block
                with store.open_input_file(name) as file:
                    data = file.read_at(min(block, row["length"] - start), start)
                ids = np.frombuffer(data, WIDTHS[width])
                at = np.flatnonzero(ids == end)
                tail = len(ids) - 1 - int(at[-1]) if len(at) else len(ids)
                heads = [ids[a + 1:min(b, a + 1 + head)].tolist() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_pylist([{
                    "path": row["path"], "block": row["block"],
                    "is_last": start + len(data) >= row["length"], "seps": len(at), "tail": tail,
                    "size": len(ids), "first": ids[:head].tolist(),
                    "open": ids[len(ids) - tail:][:head].tolist() if len(at) else [],
                    "at": at.tolist(), "heads": heads}], schema=_BLOCK)
    return run


_BLOCK = pa.schema([
    ("path", pa.string()), ("block", pa.int64()), ("is_last", pa.bool_()), ("seps", pa.int64()),
    ("tail", pa.int64()), ("size", pa.int64()), ("first", pa.list_(pa.int64())),
    ("open", pa.list_(pa.int64())), ("at", pa.list_(pa.int64())),
    ("heads", pa.list_(pa.list_(pa.int64())))])


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id",
                 text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, counted in token files written below `path`.

    A row for each row of `docs`: repeated rows and null ids are kept, null and empty texts
    count 0. Without a path, the session's shared scratch folder is used.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, pattern, doc_id, text)
    found = scan_tokens(spark, path, END, 2, HEAD)
    top = F.element_at("head", 1)
    number = (F.floor(top / 3).cast("long") * DIGIT + F.element_at("head", 2)) * DIGIT
    number = ((number + F.element_at("head", 3)) * DIGIT + F.element_at("head", 4)) * DIGIT
    number = number + F.element_at("head", 5)
    return found.select(
        F.when(top % 3 == 2, None).when(top % 3 == 1, -number).otherwise(number).alias(doc_id),
        (F.col("n_tokens") - HEAD).alias("n_tokens"))
