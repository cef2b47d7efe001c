"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct k-word shingles; two documents link when intersection / union >= threshold.
Linked sets x, y share at least T(x) = ceil(threshold * |x|) shingles, so of any |x| - T(x) + 1 shingles of x, chosen by
one order for all documents, at least one is shared as well. The order puts short inverted lists first: a document is
looked up through these only, and the long ones (passages that many documents share) are left for the probe: DivideSkip
with T - 1 lists as the long ones, so that one occurrence in the short ones makes a candidate.

1. One pass over the texts gives each document's set size and set digest, and the shingles as 32-bit residues dealt into
   buckets by their leading bits. A bucket tells which shingles occur more than once, and which are frequent; both go
   into filters of bounded size. A filter only shapes the order, so its errors never change the result. Rows whose text an
   earlier id has give no residues and no postings: else each shingle of a copied text would be a repeated one.
2. A second pass emits the postings of the short lists. A shingle that the filter rules out occurs once and needs no
   posting, so mostly documents with near copies emit any. (If there are too many repeated shingles for the filter, it
   takes those above a higher count and every short list is posted.) Documents with equal sets count as one class.
3. Each list with several classes ties them to its smallest digest; the distinct ties form candidate groups.
4. A group's sets meet in blocks of bounded size. Within a pair of blocks the short lists are merged (a stable sort of the
   lists in a row, which merges sorted runs; a heap of Python objects gives the same counts slower), the longest ones are
   probed by binary search in the candidates that are still short of T (DivideSkip), and the exact overlap decides. A
   block pair returns a spanning forest of its links, so that copies are never expanded into pairs. First each block of a
   group meets the group's first block: in a crowd of near copies that connects nearly all, with work in proportion to
   the crowd. Then only the sets outside the component of the group's first set meet all blocks; pairs inside it can't
   change the result. (Only a large group of which much doesn't link costs its size times what is left.)
5. Connected components by star contraction; component_id is the smallest doc_id reachable.

Digests have 64 bits and a class is (digest, size). No candidate, partner or list is capped.

Null ids are dropped (they can't be named in the result); null or wordless texts have no shingles and stay alone. Equal
texts are one class. Repeated rows of one id are one document; an id with several texts links by each of them, and
n_shingles is its largest set's. Columns with other names are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagelake.llm.common import forget, unused, written
from lineagelake.llm.components import components
from lineagelake.llm.shingles import WordHashes, mix, release, shingle_set

SHINGLE_WORDS = 5
#: Similarity in hundredths, so that the test is exact.
THRESHOLD = 75
#: Bits of the filter of repeated shingles, broadcast as 1/8 bytes; bits of that of frequent ones; probes of either.
REPEATED_BITS, FREQUENT_BITS, PROBES = 28, 24, 3
#: Bits for each repeated shingle below which the filter has twice the bits, and below which it doesn't take all.
ROOMY, LEAST_BITS = 8, 4
#: Occurrences from which a shingle is frequent; a task's chunk counts up to CHUNK_COUNT.
FREQUENT, CHUNK_COUNT = 64, 15
#: Characters of text behind a bucket of residues; shingles of a chunk.
BUCKET_CHARS, CHUNK_SHINGLES = 1 << 20, 1_000_000
#: Filter bits sent by a task in one row.
CHUNK_BITS = 1 << 20
#: Bytes of class names that executors get whole, so that texts needn't be shuffled to them.
MAX_BROADCAST = 64 << 20
#: Documents in a block; two blocks meet in a task.
BLOCK = 256
#: Postings gathered before they leave the Python side; digests of texts that a task remembers, to count copies once.
BATCH_POSTINGS, SEEN = 200_000, 200_000

PROFILE = "doc_id long, n int, digest long, bucket int, residues binary"


def _set_digest(tokens: np.ndarray) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)


def _profile(batches: Iterator[pa.RecordBatch], k: int, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    words, seen, held, size = WordHashes(), set(), [], 0
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("digest", pa.int64()), ("bucket", pa.int32()), ("residues", pa.binary())])

    def flush() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens = np.repeat(tokens, np.minimum(counts, CHUNK_COUNT))
        cuts = np.searchsorted(tokens, np.arange(1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits)).tolist() + [len(tokens)]
        residues = (tokens >> np.uint64(32 - bucket_bits)).astype(np.uint32)
        full = [b for b in range(1 << bucket_bits) if cuts[b] < cuts[b + 1]]
        n = len(full)
        blobs = pa.array([residues[cuts[b] : cuts[b + 1]].tobytes() for b in full], pa.binary())
        return pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(full, pa.int32()), blobs], schema=schema)

    for batch in batches:
        ids, sizes, digests = batch.column("doc_id").to_pylist(), [], []
        for text, again in zip(batch.column("text"), batch.column("again").to_pylist()):
            tokens = shingle_set(words.of(text.as_py()), k)
            digest = _set_digest(tokens)
            sizes.append(len(tokens))
            digests.append(digest)
            if len(tokens) and not again and digest not in seen:  # equal sets in one task count once
                if len(seen) < SEEN:
                    seen.add(digest)
                held.append(tokens)
                size += len(tokens)
                if size >= CHUNK_SHINGLES:
                    yield flush()
                    held, size = [], 0
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.int64()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], schema=schema)
    if held:
        yield flush()
    release()


def _places(bucket: np.ndarray, residue: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """A shingle's bit in the filter for each probe."""
    h = mix((bucket.astype(np.uint64) << np.uint64(32)) | residue.astype(np.uint64))
    for i in range(PROBES):
        yield mix(h + np.uint64(i)) >> np.uint64(64 - bits)


class Filters:
    """Which shingles are repeated or frequent; may err towards yes."""

    def __init__(self, repeated: np.ndarray, frequent: np.ndarray, complete: bool, bucket_bits: int):
        self.parts, self.complete, self.bucket_bits = tuple((bits, (8 * len(bits)).bit_length() - 1) for bits in (repeated, frequent)), complete, bucket_bits

    def levels(self, tokens: np.ndarray) -> np.ndarray:
        """0: not known to be repeated, 1: repeated, 2: frequent as well."""
        level = np.zeros(len(tokens), np.uint8)
        at = np.arange(len(tokens))
        for bits, size in self.parts:
            b, r = (tokens[at] >> np.uint64(64 - self.bucket_bits) if self.bucket_bits else np.zeros(len(at), np.uint64)), (tokens[at] >> np.uint64(32 - self.bucket_bits)).astype(np.uint32)
            hit = np.ones(len(at), bool)
            for p in _places(b, r, size):
                hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at = at[hit]
            level[at] += 1
        return level


def _filters(profile: DataFrame, bucket_bits: int) -> Filters:
    """Built by bucket; only filters of fixed size and a histogram of counts come to the driver."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        residues, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["residues"]]), return_counts=True)
        many = n > 1
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "residues": [residues[many].tobytes()], "counts": [np.minimum(n[many], 255).astype(np.uint8).tobytes()]})

    counted = written(profile.filter("bucket is not null").select("bucket", "residues").groupBy("bucket").applyInPandas(count, "bucket int, residues binary, counts binary"))

    def histogram(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, np.int64)
        for pdf in parts:
            for x in pdf["counts"]:
                total += np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        yield pd.DataFrame({"c": range(256), "n": total})

    by_count = np.zeros(256, np.int64)
    for r in counted.select("counts").mapInPandas(histogram, "c int, n long").groupBy("c").sum("n").collect():
        by_count[r[0]] = r[1]
    at_least = np.cumsum(by_count[::-1])[::-1]
    size = REPEATED_BITS + (at_least[2] * ROOMY > 1 << REPEATED_BITS)
    least = next((c for c in range(2, 256) if at_least[c] <= (1 << size) // LEAST_BITS), 256)
    often = next((c for c in range(max(least, FREQUENT), 256) if at_least[c] <= (1 << FREQUENT_BITS) // 16), 256)

    def bits_of(least: int, size: int) -> np.ndarray:
        def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = np.zeros(1 << (size - 3), np.uint8)
            for pdf in parts:
                for b, x, c in zip(pdf["bucket"], pdf["residues"], pdf["counts"]):
                    r = np.frombuffer(x, np.uint32)[np.frombuffer(c, np.uint8) >= least]
                    for p in _places(np.full(len(r), b), r, size):
                        np.bitwise_or.at(own, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            packed = own.reshape(-1, CHUNK_BITS // 8)
            full = np.flatnonzero(packed.any(1))
            yield pd.DataFrame({"chunk": full, "bits": [packed[i].tobytes() for i in full]})

        def either(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]]).tobytes()]})

        out = np.zeros(1 << (size - 3), np.uint8)
        parts = counted.coalesce(8).mapInPandas(make, "chunk int, bits binary")
        for r in parts.groupBy("chunk").applyInPandas(either, "chunk int, bits binary").collect():
            out[r.chunk * (CHUNK_BITS // 8) : (r.chunk + 1) * (CHUNK_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
        return out

    out = Filters(bits_of(least, size), bits_of(often, FREQUENT_BITS), least == 2, bucket_bits)
    forget(counted)
    return out


def least_overlap(n: int | np.ndarray, threshold: int) -> int | np.ndarray:
    return -(-threshold * n // 100)


def short_lists(tokens: np.ndarray, filters: Filters, threshold: int) -> np.ndarray:
    """Those of the |x| - T + 1 shingles of x with the shortest lists that may have a list of two; ties by the hash."""
    m = len(tokens) - least_overlap(len(tokens), threshold) + 1
    levels = filters.levels(tokens)
    first = np.argsort(levels, kind="stable")[:m]  # tokens are sorted
    return tokens[first[levels[first] > 0]] if filters.complete else tokens[first]


def _postings(batches: Iterator[pa.RecordBatch], k: int, threshold: int, filters: Filters) -> Iterator[pa.RecordBatch]:
    words, seen = WordHashes(), set()
    out, owners, size = [], [], 0

    def flush() -> pa.RecordBatch:
        tokens = np.concatenate(out).view(np.int64)
        digests = np.repeat(np.array([d for d, _ in owners], np.int64), [n for _, n in owners])
        return pa.record_batch([pa.array(tokens), pa.array(digests)], names=["token", "digest"])

    for batch in batches:
        for text in batch.column("text"):
            tokens = shingle_set(words.of(text.as_py()), k)
            if not len(tokens) or (digest := _set_digest(tokens)) in seen:
                continue
            if len(seen) < SEEN:
                seen.add(digest)
            own = short_lists(tokens, filters, threshold)
            out.append(own)
            owners.append((digest, len(own)))
            size += len(own)
            if size >= BATCH_POSTINGS:
                yield flush()
                out, owners, size = [], [], 0
    if out:
        yield flush()
    release()


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        kept = {"digest": [], "rep": [], "tokens": []}
        for text, digest, rep in zip(batch.column("text"), batch.column("digest"), batch.column("rep")):
            tokens = shingle_set(words.of(text.as_py()), k)
            if _set_digest(tokens) == digest.as_py():  # else another text with the same id
                for name, x in (("digest", digest.as_py()), ("rep", rep.as_py()), ("tokens", tokens.tobytes())):
                    kept[name].append(x)
        yield pa.record_batch([pa.array(kept["digest"], pa.int64()), pa.array(kept["rep"], pa.int64()), pa.array(kept["tokens"], pa.binary())], names=list(kept))
    release()


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets numbered left and those numbered right (equal arrays: within).

    DivideSkip: for each query set the lists of the group's inverted index are split; short ones are merged by counting,
    long ones probed by binary search for those candidates that may still reach the required overlap.
    """
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # inverted index over the right side
    flat = np.concatenate([sets[j] for j in right]) if len(right) else np.zeros(0, np.uint64)
    owner = np.repeat(right, sizes[right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    within = left is right
    found = []
    for i in left:
        x = sets[i]
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        length = hi - lo
        if not length.sum():
            continue
        need = least_overlap(len(x), threshold)
        by = np.argsort(-length, kind="stable")
        n_long = min(need - 1, int((length >= max(32, len(right) // 4)).sum()))
        long, short = by[:n_long], by[n_long:]
        n = length[short]
        total = int(n.sum())
        at = np.repeat(lo[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        merged = np.sort(owner[at], kind="stable")
        cuts = np.flatnonzero(np.diff(merged, prepend=-1))
        counts = np.diff(np.append(cuts, total))
        enough = counts >= max(1, need - n_long)
        for j, overlap in zip(merged[cuts[enough]].tolist(), counts[enough].tolist()):
            if j == i or (within and j < i) or root(i) == root(j):
                continue
            if 100 * min(len(x), sizes[j]) < threshold * max(len(x), sizes[j]):
                continue
            if n_long:
                probe, y = x[long], sets[j]
                pos = np.minimum(np.searchsorted(y, probe), len(y) - 1)
                overlap += int((y[pos] == probe).sum())
            if 100 * overlap >= threshold * (len(x) + int(sizes[j]) - overlap):
                found.append((int(i), int(j)))
                parent[root(i)] = root(j)
    return found


def _verify(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links between the rows of side LEFT and those of side RIGHT, or among those of side BOTH."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["tokens"]]
    side, reps = pdf["side"].to_numpy(), pdf["rep"].to_numpy()
    left = np.flatnonzero(side != RIGHT)
    right = left if (side == BOTH).all() else np.flatnonzero(side != LEFT)
    pairs = linked_pairs(sets, left, right, threshold)
    return pd.DataFrame({"a": [reps[x] for x, _ in pairs], "b": [reps[y] for _, y in pairs]}, dtype="int64")


LEFT, RIGHT, BOTH = 0, 1, 2


def _marked(base: DataFrame) -> DataFrame:
    """base (doc_id, text) with `again`: whether an earlier id has the same text."""
    keyed = base.filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("m"))
    first = keyed.groupBy("h", "m").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "m", "first")
    later = written(keyed.join(first, ["h", "m"]).filter("doc_id > first").select(F.xxhash64("doc_id", "h", "m").alias("again")).distinct())
    near = F.broadcast(later) if later.count() * 24 <= MAX_BROADCAST else later
    key = F.xxhash64("doc_id", F.xxhash64("text"), F.length("text"))
    return base.withColumn("key", key).join(near, F.col("key") == F.col("again"), "left").select("doc_id", "text", F.col("again").isNotNull().alias("again"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id is not null")
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    bucket_bits = min(30, max(0, (chars // BUCKET_CHARS).bit_length()))
    marked = _marked(base)
    profile = written(marked.mapInArrow(lambda b: _profile(b, k, bucket_bits), PROFILE))
    filters = spark.sparkContext.broadcast(_filters(profile, bucket_bits))
    known = written(profile.filter("bucket is null").select("doc_id", "n", "digest"))
    forget(profile)  # what only one step reads goes when it is done
    classes = known.filter("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"))

    postings = marked.filter("not again").select("text").mapInArrow(lambda b: _postings(b, k, threshold, filters.value), "token long, digest long")
    # most lists have one class and end here; a common list's rows are split over tasks by the join, its minimum is taken map-side
    postings = written(postings)
    centers = written(postings.groupBy("token").agg(F.min("digest").alias("center"), F.max("digest").alias("last")).filter("center < last").select("token", "center"))
    ties = written(postings.join(centers, "token").filter("digest != center").select("center", "digest").distinct())

    forget(postings, centers)
    members = ties.unionByName(ties.select("center", F.col("center").alias("digest")).distinct())
    blocks = written(ties.groupBy("center").agg(F.expr(f"int(ceil((count(1) + 1) / {BLOCK}))").alias("nb")))
    placed = written(members.join(blocks, "center").withColumn("block", F.expr("int(pmod(xxhash64(digest), nb))")))

    wanted = written(members.select("digest").distinct().join(classes, "digest").select("digest", "rep"))
    near = F.broadcast(wanted) if wanted.count() * 24 <= MAX_BROADCAST else wanted
    texts = base.join(near, base["doc_id"] == near["rep"]).select("text", "digest", "rep")
    sets = written(texts.mapInArrow(lambda b: _sets(b, k), "digest long, rep long, tokens binary").dropDuplicates(["digest", "rep"]))

    def compared(meets: DataFrame) -> DataFrame:
        return written(meets.join(sets, "digest").groupBy("center", "bi", "bj").applyInPandas(lambda pdf: _verify(pdf, threshold), "a long, b long"))

    meets = f"if(block = 0, transform(sequence(0, nb - 1), x -> named_struct('bj', x, 'side', if(x = 0, {BOTH}, {LEFT}))), array(named_struct('bj', block, 'side', {RIGHT})))"
    edges = compared(placed.select("center", "digest", F.lit(0).alias("bi"), F.inline(F.expr(meets))))
    # the classes of an id with several texts belong together
    several = known.filter("n > 0").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").select("doc_id")
    several = known.join(several, "doc_id").join(classes, ["digest", "n"]).select("doc_id", "rep")
    several = several.join(several.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").filter("rep != b").select(F.col("rep").alias("a"), "b")
    several = written(several)
    comp = components(edges.unionByName(several))
    if not blocks.filter("nb > 1").isEmpty():
        labels = wanted.join(comp, wanted["rep"] == comp["id"], "left").select("digest", F.coalesce("component", "rep").alias("label"))
        inside = placed.filter("nb > 1").join(labels, "digest")
        inside = written(inside.join(inside.filter("digest = center").select("center", F.col("label").alias("home")), "center"))
        rest = inside.filter("label != home")
        left_blocks = written(rest.groupBy("center").agg(F.expr(f"int(ceil(count(1) / {BLOCK}))").alias("nr")))
        left = rest.join(left_blocks, "center").select("center", "digest", F.expr("int(pmod(xxhash64(digest, 1), nr))").alias("bi"), F.explode(F.expr("sequence(0, nb - 1)")).alias("bj"), F.lit(LEFT).alias("side"))
        right = inside.join(left_blocks, "center").select("center", "digest", F.explode(F.expr("sequence(0, nr - 1)")).alias("bi"), F.col("block").alias("bj"), F.lit(RIGHT).alias("side"))
        comp = components(edges.unionByName(compared(left.unionByName(right))).unionByName(several))
        forget(inside, left_blocks)
    forget(sets, placed, blocks, wanted, ties)
    labels = classes.join(comp, classes["rep"] == comp["id"], "left").select("digest", "n", F.coalesce("component", "rep").alias("component_id"))
    out = known.join(labels, ["digest", "n"], "left")
    return out.groupBy("doc_id").agg(F.max(F.col("n").cast("long")).alias("n_shingles"), F.min(F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """docs with one document, that of the smallest id, of each component; documents without an id stay.

    Equal rows of a kept id are one; if its rows differ in any column, all stay.
    """
    name = how.get("doc_id", "doc_id")
    own = unused("kept", docs)
    kept = jaccard_components(docs, **how).filter("component_id = doc_id").select(F.col("doc_id").alias(own))
    compared = [c for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant"))]
    named = docs.join(kept, docs[name].cast("long") == kept[own], "left_semi").dropDuplicates(compared)
    return named.unionByName(docs.filter(F.col(name).isNull()))
