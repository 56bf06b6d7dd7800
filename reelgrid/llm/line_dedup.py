"""Line deduplication over the suffix array of line sequences, in DataFrame functions only.

A line becomes a 128-bit identifier. Distributed prefix doubling ranks the suffixes of every document
by their first 1, 2, 4, ... lines: the rank of a suffix and that of the suffix as many lines further
on are its key at the next level, and ranks are the places of keys in their sorted order. So the
suffixes of one rank are one interval of the suffix array whose longest common prefix has at least
that many lines. A suffix whose rank is single, or that ends before the prefix does, takes no part in
later levels; doubling ends when none is left. Of each interval the first suffix, in the order of
(doc_id, row, line), is the original and all others are later copies. What the later copies in a
document cover, each to the depth of its deepest interval, are its maximal repeated runs: they are deleted.

A copy counts if it has at least MIN_LINES lines or MIN_WORDS words. Whether it is long enough is seen
at exactly the length that it needs, so prefixes of all lengths up to MIN_LINES are ranked too.

Lines are what `\n` separates. Defined results: a null text stays null and has no lines; empty lines
are lines like any other; a null doc_id comes first; repeated rows are documents of their own, of
which the later lose their runs; extra columns are kept by deduplicated(), whatever their names, but
docs with a column n_lines or n_deleted are refused; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, free_name, numbered, parts_of_hot, stored

MIN_LINES, MIN_WORDS = 3, 20


def identifier(of: Column) -> Column:
    return F.substring(F.unhex(F.sha2(of, 256)), 1, 16)


def lines(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """_row, doc_id, _line, _id and _need of every line of docs (_row, doc_id, text).

    _need: how many lines a run that begins here must have, to count.
    """
    words = lambda x: F.size(F.filter(F.split(x, SPACE + "+"), lambda w: w != ""))
    rows = docs.select("_row", "doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(identifier(x).alias("id"), words(x).alias("words"))).alias("_all"))

    def need(i: Column) -> Column:
        """One more than the prefixes that have too few words."""
        begin = F.struct(F.lit(0).alias("sum"), F.lit(1).alias("n"))
        more = lambda at, x: F.struct((at["sum"] + x["words"]).alias("sum"), (at["n"] + F.when(at["sum"] + x["words"] < min_words, 1).otherwise(0)).alias("n"))
        return F.aggregate(F.slice("_all", i + 1, min_lines - 1), begin, more, lambda at: at["n"])

    told = rows.select("_row", "doc_id", F.transform("_all", lambda x, i: F.struct(x["id"].alias("id"), need(i).alias("need"))).alias("_of"))
    # The outer form: for the inner one Spark adds a filter that computes the arrays again.
    each = told.select("_row", "doc_id", F.posexplode_outer("_of").alias("_line", "_of")).where("_line is not null")
    return each.select("_row", "doc_id", "_line", F.col("_of.id").alias("_id"), F.col("_of.need").alias("_need"))


def ranked(suffixes: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """_row, doc_id, _line, _need, _rank, _later of the suffixes whose keys others have too.

    Ranks ascend with the keys. A key's suffixes are counted, and told their rank, in parts.
    """
    place = F.struct("doc_id", "_row", "_line")
    rows = suffixes.withColumn("_part", F.pmod(F.hash("_row", "_line"), F.lit(parts)))
    by_part = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    several = by_part.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first")).where("_n > 1")
    intervals = stored(several.select(*keys, "_first").orderBy(*keys).withColumn("_place", F.monotonically_increasing_id()))
    told = by_part.select(*keys, "_part").join(intervals, keys)
    later = (F.col("_row") != F.col("_first._row")) | (F.col("_line") != F.col("_first._line"))
    return stored(rows.join(told, [*keys, "_part"]).select("_row", "doc_id", "_line", "_need", F.col("_place").alias("_rank"), later.alias("_later")))


def longer(level: DataFrame, step: int) -> DataFrame:
    """Each suffix with the rank of the suffix step lines on, if that has one."""
    on = level.select("_row", (F.col("_line") - step).alias("_line"), F.col("_rank").alias("_next"))
    return level.drop("_later").join(on, ["_row", "_line"])


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """_row, _line, _length of each later copy that counts, to the deepest level at which it is one; docs: _row, doc_id, text."""
    parts = parts_of_hot(docs)
    level, length = ranked(stored(lines(docs, min_lines, min_words)), ["_id"], parts), 1
    found = []
    while True:
        found.append(copies_of(level, length))
        exact = [length + step for step in range(1, length) if length + step <= min_lines]
        for between in exact:
            found.append(copies_of(ranked(longer(level, between - length), ["_rank", "_next"], parts), between))
        level = ranked(longer(level, length), ["_rank", "_next"], parts)
        length *= 2
        if level.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out.groupBy("_row", "_line").agg(F.max("_length").alias("_length"))


def copies_of(level: DataFrame, length: int) -> DataFrame:
    """The later copies of a level that are as long as they need to be."""
    return level.where(F.col("_later") & (F.col("_need") <= length)).select("_row", "_line", F.lit(length).alias("_length"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """_row, _start, _end (the line after the last): the maximal runs of lines that later copies cover; docs: _row, doc_id, text."""
    copies = later_copies(docs, min_lines, min_words).withColumn("_end", F.col("_line") + F.col("_length"))
    order = Window.partitionBy("_row").orderBy("_line")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = copies.withColumn("_new", F.when(F.col("_line") > reach, 1).when(reach.isNull(), 1).otherwise(0))
    told = begins.withColumn("_run", F.sum("_new").over(order))
    return told.groupBy("_row", "_run").agg(F.min("_line").alias("_start"), F.max("_end").alias("_end")).drop("_run")


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines of later copies; the columns n_lines and n_deleted are added."""
    if taken := {"n_lines", "n_deleted"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns that the result adds: {sorted(taken)}")
    key, gone, split = (free_name(docs, x) for x in ("_row", "_gone", "_split"))
    marked = numbered(docs, key)
    runs = repeated_runs(marked.select(F.col(key).alias("_row"), "doc_id", "text"), min_lines, min_words)
    by_row = runs.groupBy(F.col("_row").alias(key)).agg(F.array_sort(F.collect_list(F.struct("_start", "_end"))).alias(gone))
    rows = marked.withColumn(split, F.split("text", "\n")).drop("text").join(by_row, key, "left")
    # What lies between the runs is kept: one slice each, so the work grows with the lines and the runs.
    n = F.size(split)
    starts = F.concat(F.transform(gone, lambda r: r["_start"]), F.array(n))
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["_end"]))
    bare = F.flatten(F.zip_with(ends, starts, lambda e, s: F.slice(split, e + 1, s - e)))
    deleted = F.aggregate(gone, F.lit(0), lambda at, r: at + r["_end"] - r["_start"])
    out = rows.withColumn("n_lines", F.coalesce(F.when(F.col(split).isNotNull(), n), F.lit(0)).cast("long")).withColumn("n_deleted", F.coalesce(deleted, F.lit(0)).cast("long"))
    out = out.withColumn("text", F.array_join(F.when(F.col(gone).isNull(), F.col(split)).otherwise(bare), "\n"))
    return out.select(*docs.columns, "n_lines", "n_deleted")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), w AS (
  SELECT doc_id, i, line, lead(line, 1) OVER o AS l1, lead(line, 2) OVER o AS l2, lead(i, 1) OVER o AS i1, lead(i, 2) OVER o AS i2,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, i1, i2, words, words + coalesce(lead(words, 1) OVER (PARTITION BY doc_id ORDER BY i), 0) AS words2,
    row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k1,
    row_number() OVER (PARTITION BY line, l1, i1 IS NULL ORDER BY doc_id, i) AS k2,
    row_number() OVER (PARTITION BY line, l1, l2, i2 IS NULL ORDER BY doc_id, i) AS k3
  FROM w
), gone AS (
  SELECT doc_id, i FROM r WHERE k1 > 1 AND words >= 20
  UNION
  SELECT doc_id, i + j AS i FROM r, (VALUES (0), (1)) AS t(j) WHERE i1 IS NOT NULL AND k2 > 1 AND words2 >= 20
  UNION
  SELECT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) AS t(j) WHERE i2 IS NOT NULL AND k3 > 1
), kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_deleted,
    coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_deleted, 0) AS n_deleted, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
