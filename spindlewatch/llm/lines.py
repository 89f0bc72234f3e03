"""Fuzzy line dedup: MinHash over character shingles, verified, joined into components.

A line's shingles are 12 characters long and start at the words of the line, and at every character
of a word longer than that: in text without blanks, too, a change touches only those around it.
Their hashes give `rows * bands / 2` minima, under as many rotations of the order of hashes: the
minimum that starts the order at a mark is the first hash at or above the mark, around the ring.
So one sort gives all minima, and two lines agree in one with a probability of their similarity. A
band is `rows` of them, and each minimum is in two bands; two bands share one minimum at most.
Lines that agree in a whole band become candidates: with 4 rows and 10 bands about 99.5 % of the
pairs whose similarity is 0.8, and more above. Candidates are compared by the exact Jaccard
similarity of their shingle sets, and linked lines are joined by distributed union-find. Each component keeps one line: that of the
smallest doc_id, and there the first. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from spindlewatch.llm.components import link, may_hold, size_band
from spindlewatch.session import stage

WIDTH = 12
ROWS = 4
BANDS = 10
SIMILAR = 0.8


def line_key(line: Column) -> Column:
    """Identity of a line: its text without white space at the ends."""
    return F.xxhash64(trimmed(line))


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\x0b\x0c\r"))


def shingles(line: Column) -> Column:
    """Hashes of the line's shingles, with repeats."""
    # A match looks ahead for a shingle and goes on by a whole short word, or one character of a longer one.
    found = F.regexp_extract_all(trimmed(line), F.lit(
        rf"(?=((?<!\S)\S.{{0,{WIDTH - 1}}}|\S.{{{WIDTH - 1}}}))(?:(?<!\S)\S{{1,{WIDTH}}}(?!\S)|\S)\s*"), F.lit(1))
    return F.transform(found, lambda s: F.xxhash64(s))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), where `value` is computed once though functions over arrays use it many times."""
    return F.transform(F.array(value), make)[0]


def with_rings(hashed: DataFrame, count: int) -> DataFrame:
    """`hashed`, its array s replaced by `own`, sorted, and `ring`, sorted with `count` marks.

    Both are columns of their own, as they are sorted in compiled code only outside of a function
    over arrays. The optimizer leaves them apart, since `minima` names `own` twice.
    """
    return hashed.select(*[c for c in hashed.columns if c != "s"], F.sort_array("s").alias("own"),
                         F.sort_array(F.concat("s", marks(count))).alias("ring"))


def marks(count: int) -> Column:
    return F.array(*[F.lit(-(1 << 63) + i * ((1 << 64) // count)).cast("long") for i in range(count)])


def minima(count: int) -> Column:
    """From `own` and `ring`: the first hash after each of `count` marks, around the ring.

    A mark's place in `ring`, less the marks before it, is that of its first hash in `own`. Short
    functions over arrays: a column per minimum makes generated code too long to be compiled.
    """
    return F.transform(marks(count), lambda m, i: F.get("own", (
        (F.array_position("ring", m) - 1 - i) % F.size("own")).cast("int")))


def band_keys(sig: Column, rows: int, bands: int) -> Column:
    """A key per band from the minima of a line."""
    half = bands // 2
    chosen = [[b * rows + r for r in range(rows)] for b in range(half)]
    chosen += [[b + r * half for r in range(rows)] for b in range(half)]
    places = F.array(*[F.array(*map(F.lit, one)) for one in chosen])
    return F.transform(places, lambda band: F.xxhash64(band, F.transform(band, lambda i: F.get(sig, i))))


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, line_no, line) of the lines that are not blank; rows with a null id are left out."""
    return (docs.filter(F.col(doc_id).isNotNull())
            .select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
            .filter(trimmed(F.col("line")) != ""))


def signed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", count: int = ROWS * BANDS // 2) -> DataFrame:
    """(doc_id, line_no, k, n, sig), staged: key and distinct shingles of every line, half of each of its minima's bits."""
    hashed = split_lines(docs, doc_id, text).select(
        "doc_id", "line_no", line_key(F.col("line")).alias("k"), shingles(F.col("line")).alias("s"))
    least = F.transform(minima(count), lambda x: F.shiftright(x, 32).cast("int"))
    return stage(with_rings(hashed, count).select(
        "doc_id", "line_no", "k", F.size(F.array_distinct("own")).alias("n"), least.alias("sig")), "signed-lines")


def line_classes(docs: DataFrame, signed: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 similar: float = SIMILAR, rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """Components of similar lines (node, component) by line key, and the links between keys.

    signed is what `signed_lines` makes of docs. Lines that are equal have one key and need no link;
    keys without a link are not listed. Pairs are compared by their whole shingle sets, which are made
    once, for the lines that share a band with another.
    """
    postings = signed.select(F.explode(band_keys(F.col("sig"), rows, bands)).alias("key"), F.col("k").alias("node"),
                             size_band(F.col("n"), similar).alias("band"))

    def signatures(nodes: DataFrame) -> DataFrame:
        wanted = nodes.withColumnRenamed("node", "k")
        keyed = split_lines(docs, doc_id, text).select(line_key(F.col("line")).alias("k"), "line")
        # An inner join: the optimizer would put a semi join ahead of the filter.
        return (may_hold(keyed, "k", wanted).join(wanted, "k").groupBy("k").agg(F.any_value("line").alias("line"))
                .select(F.col("k").alias("node"), F.struct(F.array_distinct(shingles(F.col("line"))).alias("items")).alias("sig")))

    def agree(a: Column, b: Column) -> Column:
        m, n = F.size(a["items"]), F.size(b["items"])
        # A smaller set cannot fill its share of a much larger one.
        fits = F.least(m, n) >= F.lit(similar) * F.greatest(m, n)
        common = F.size(F.array_intersect(a["items"], b["items"]))
        return F.when(fits, common >= F.lit(similar) * (m + n - common)).otherwise(False)

    return link(postings, signatures, agree)


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS,
                  bands: int = BANDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, gone): numbers of the lines that each document loses, for documents that lose any."""
    signed = signed_lines(docs, doc_id, text, rows * bands // 2)
    found = stage(line_classes(docs, signed, doc_id, text, similar, rows, bands)[0], "line-classes")
    lines = signed.select("doc_id", "line_no", "k")
    # A key that is neither repeated nor linked loses nothing, and most keys end here.
    per_key = lines.groupBy("k").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    classed = stage(per_key.join(found.withColumnRenamed("node", "k"), "k", "left")
                    .filter("n > 1 or component is not null")
                    .select("k", F.coalesce("component", "k").alias("c"), "first", "n"), "key-classes")
    keep = (classed.groupBy("c").agg(F.min("first").alias("kept"), F.sum("n").alias("n"))
            .filter("n > 1").select("c", "kept"))
    losing = stage(classed.select("k", "c").join(keep, "c").select("k", "kept"), "losing-keys")
    gone = (may_hold(lines, "k", losing.select("k")).join(losing, "k")
            .filter("doc_id <> kept.doc_id or line_no <> kept.line_no"))
    return gone.groupBy(F.col("doc_id").alias(doc_id)).agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the deduplicated text, and n_lines and n_gone: lines before, and removed.

    A line is what stands between line feeds. Blank lines are never compared and stay. Null texts
    stay null, with no line. Rows with a null id are not compared and stay as they are. Rows that
    share an id are read as one document and lose lines by the same numbers. Columns named n_lines
    and n_gone are replaced.
    """
    gone = removed_lines(docs, doc_id, text, **options).withColumnRenamed(doc_id, "gone_doc")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_gone", "gone", "gone_doc")]
    lines = F.split(text, "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = once(lines, lambda whole: F.array_join(F.transform(numbers, lambda i: whole[i]), "\n"))
    return (docs.select(*names).join(gone, F.col(doc_id) == F.col("gone_doc"), "left")
            .select(*[F.when(F.col("gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c)
                      for c in names],
                    F.coalesce(F.size(F.filter(lines, lambda x: trimmed(x) != "")), F.lit(0)).alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone")))
