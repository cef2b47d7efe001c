"""Line dedup by winnowing over line hashes. DataFrame operations only.

A window is a run of `run` lines, or of fewer lines with at least `long` characters. A window that equals one at an
earlier place (by doc_id, then by line) is a repeat, and its lines go; the first occurrence stays. Longer runs are unions
of windows, so a repeated run of `run` lines or `long` characters is deleted to its full length both ways.

1. Lines are hashed; the line of a window with the least hash (the last of equals) is its fingerprint. Two equal windows
   have the same fingerprint at the same place, so each repeated run is guaranteed to share fingerprints, at about two
   places in run + 1 lines.
2. Fingerprints are counted with map-side sums; only places whose fingerprint occurs twice are joined on. In a corpus of
   mostly unique lines few are left.
3. A joined fingerprint is extended both ways to the windows it stands for: the line hashes before and after it within
   the window. Equal windows are met by a 96-bit digest, whose first place is found with map-side minima; a window at
   any other place is a repeat. A very common window costs a row for each place and never a pair, and the join to its
   first place is one that Spark splits over tasks.
4. The places of repeats come together by document, as line numbers, and the document's lines at these are dropped. The
   texts stay where they are while the documents with repeats can be broadcast (MAX_BROADCAST bytes), and are shuffled
   to them beyond that.

Windows do not cross documents; a text of fewer than `run` lines has those with `long` characters only. Null ids and null
texts are passed through untouched. Rows equal in id and text are one document twice, not repeats of each other;
rows of one id with different texts are different documents, in the order of their text's hash. Empty lines are lines.
Texts of any length are cut whole; an empty table gives an empty result. Columns named n_lines, n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import unused, written

RUN_LINES, LONG_CHARS = 3, 300
#: Bytes of repeats that executors get whole.
MAX_BROADCAST = 64 << 20


def repeated_windows(docs: DataFrame, run: int = RUN_LINES, long: int = LONG_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, gone): the lines, 0-based, of the windows of a document that occurred before.

    row: the text's hash, which tells apart different texts of one id.
    """
    lines = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.expr(f"split(`{text}`, '\n', -1)").alias("l"))
    lines = lines.select("doc_id", "row", F.expr("transform(l, x -> xxhash64(x))").alias("h"), F.expr("transform(l, x -> length(x))").alias("c"))
    # each window: its first line, its number of lines, the place of its least hash (the last of equals), that hash, its digest
    kinds = []
    for n in range(1, run + 1):
        starts = f"if(size(h) >= {n}, sequence(0, size(h) - {n}), array())"
        if n < run:
            starts = f"filter({starts}, s -> aggregate(slice(c, s + 1, {n}), 0, (a, x) -> a + x) >= {long})"
        own = f"slice(h, s + 1, {n})"
        kinds.append(
            f"transform({starts}, s -> named_struct('s', s, 'n', {n}, 'm', s + {n} - cast(array_position(reverse({own}), array_min({own})) as int),"
            f" 'f', array_min({own}), 'd1', xxhash64({own}), 'd2', hash({own}, {n})))"
        )
    # exploded at once, and unfiltered: a filter on the array would be pushed into the lambdas, which then split the text anew
    windows = written(lines.select("doc_id", "row", F.inline(F.expr(f"concat({', '.join(kinds)})"))))
    mark = F.struct("doc_id", "row", "m")
    twice = written(windows.groupBy("f").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).filter("a != b").select("f"))
    # the windows that each repeated fingerprint stands for
    windows = written(windows.join(twice, "f", "left_semi").drop("m"))
    place = F.struct("doc_id", "row", "s")
    first = written(windows.groupBy("d1", "d2").agg(F.count("*").alias("k"), F.min(place).alias("first")).filter("k > 1").select("d1", "d2", "first"))
    later = windows.join(first, ["d1", "d2"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(s, s + n - 1)")))).alias("gone"))


def drop_repeated_runs(docs: DataFrame, run: int = RUN_LINES, long: int = LONG_CHARS, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with repeated runs cut out of the text, and the columns n_lines and n_removed."""
    base = docs.drop("n_lines", "n_removed")
    d, row, gone, cut = (unused(n, base) for n in ("d", "row", "gone", "cut"))
    later = written(repeated_windows(docs, run, long, doc_id, text).withColumnsRenamed({"doc_id": d, "row": row, "gone": gone}))
    size = later.agg(F.sum(F.size(gone) * 4 + 64)).first()[0] or 0
    out = base.join(F.broadcast(later) if size <= max_broadcast else later, (base[doc_id] == later[d]) & (F.xxhash64(base[text]) == later[row]), "left")
    out = out.withColumn(cut, F.expr(f"split(`{text}`, '\n', -1)"))
    kept = f"transform(array_except(sequence(0, size(`{cut}`) - 1), `{gone}`), i -> `{cut}`[i])"
    text_out = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.expr(kept), "\n"))
    counts = (F.coalesce(F.size(cut), F.lit(0)).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_removed"))
    return out.select(*[text_out.alias(c) if c == text else F.col(c) for c in base.columns], *counts)
