"""N-gram Jaccard join by filters of several global token orders: exact links, components of them.

1. Every text's set of five-word shingles is hashed and named by a digest; equal sets are one class from here on.
2. First order, a random permutation (the hash itself): a set's prefix is extended so that two sets that link must
   share not one but several of its tokens. A class that has too few tokens in common with other classes is done.
3. Second order, by frequency among the classes left, rarest first: the usual prefix, one shared token. The components
   of what shares a token are families of candidates.
4. Within a family the candidates must agree in the prefixes of three orders, then whole sets are compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, bitmap_of, discard, in_bitmap, materialize, texts_of
from .families import link_families
from .shingles import digest, shingle_sets

PER_CENT = 75
#: Bits of the pre-filters that are broadcast (8 MB and 4 MB), whatever the input; past their capacity they let more through.
TOKEN_BITS, ID_BITS = 26, 25


def extension(n: np.ndarray | int):
    """Tokens that two linked sets share in their extended prefixes, as a set of n asks for it."""
    return np.maximum(1, n // 10)


def _text_rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", per_cent: int = PER_CENT, tag: str = "jaccard", family_tokens: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links), n_links (documents that
    it links to).

    Null, empty or wordless texts have an empty set, link with nothing and are their own component; equal texts link.
    Repeated keys are documents of their own that share a name; null keys never name a component unless all are null.
    An empty table gives no rows; further columns are not read.
    """
    rows = _text_rows(docs, text, key)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prefixes = [], [], []
            for _, h in shingle_sets([t.encode() for t in texts_of(batch)]):
                n = len(h)
                names.append(digest(h) if n else None)
                sizes.append(n)
                prefixes.append(h[: n - -(-per_cent * n // 100) + int(extension(n))].view(np.int64) if n else None)
            lengths = np.array([0 if p is None else len(p) for p in prefixes])
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists], ["doc_id", "cls", "n", "prefix"])

    known = materialize(arrow_map(rows, first, "doc_id long, cls long, n int, prefix array<long>"), f"{tag}_prefixes")
    sizes = materialize(known.select("doc_id", "cls", "n"), f"{tag}_sizes")
    classes = sizes.where("n > 0").groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    classes = materialize(classes, f"{tag}_classes")
    broadcast = docs.sparkSession.sparkContext.broadcast
    # one document of each class speaks for it (and hardly any other); what is counted twice only lets more through
    speakers = broadcast(bitmap_of(classes, "xxhash64(doc_id)", ID_BITS))

    def prefix_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.filter(pa.array(in_bitmap(speakers.value, np.asarray(batch.column("place"))))).column("prefix")
            yield pa.RecordBatch.from_arrays([lists.flatten()], ["token"])

    owned = arrow_map(known.where("n > 0").select(F.xxhash64("doc_id").alias("place"), "prefix"), prefix_tokens, "token long")
    live = owned.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = broadcast(bitmap_of(live, "token", TOKEN_BITS))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            flags = in_bitmap(shared.value, flat)
            sums = np.concatenate([[0], np.cumsum(flags)])
            base = ends[0]
            n = np.asarray(batch.column("n"))
            # a partner is no smaller than the overlap that it must have
            need = extension(-(-per_cent * n.astype(np.int64) // 100))
            kept = np.flatnonzero(sums[ends[1:] - base] - sums[ends[:-1] - base] >= need)
            for k in range(0, len(kept), 200):
                own = kept[k : k + 200]
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(own)), pa.array(need[own], pa.int64()), pa.array([flat[a:b][flags[a:b]] for a, b in zip(ends[own] - base, ends[own + 1] - base, strict=True)], pa.list_(pa.int64()))], ["cls", "need", "tokens"])

    left = arrow_map(known.where("n > 0").select("cls", "n", "prefix"), screen, "cls long, need long, tokens array<long>")
    left = materialize(left.groupBy("cls").agg(F.first("need").alias("need"), F.first("tokens").alias("tokens")), f"{tag}_screened")
    discard(known)
    # the same once more and exactly, among the classes left
    held = left.select("cls", "need", F.explode("tokens").alias("token"))
    twice = held.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    alive = held.join(twice, "token").groupBy("cls").agg(F.count("*").alias("c"), F.first("need").alias("need")).where("c >= need").select("cls")
    alive = materialize(alive.join(classes, "cls"), f"{tag}_alive")
    wanted = broadcast(bitmap_of(alive, "xxhash64(doc_id)", ID_BITS))
    placed = rows.select("text", F.xxhash64("doc_id").alias("place"))

    def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        some = batch.filter(pa.array(in_bitmap(wanted.value, np.asarray(batch.column("place")))))
        return (h for _, h in shingle_sets([t.encode() for t in texts_of(some)]) if len(h))

    def all_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(sets_of(batch))
            flat = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
            for k in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(flat[k : k + 100_000])], ["token"])

    # of whole sets, the overlap that a link asks for must be tokens that some other class has too
    again = arrow_map(placed, all_tokens, "token long").groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    others = broadcast(bitmap_of(again, "token", TOKEN_BITS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [h for h in sets_of(batch) if in_bitmap(others.value, h).sum() >= -(-per_cent * len(h) // 100)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(h) for h in got], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in got], pa.binary())], ["cls", "tokens"])

    sets = arrow_map(placed, whole, "cls long, tokens binary").groupBy("cls").agg(F.first("tokens").alias("tokens"))
    sets = materialize(sets.join(alive.select("cls", "copies"), "cls"), f"{tag}_sets")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(b, "<i8") for b in batch.column("tokens").to_pylist()]
            sizes = np.array([len(g) for g in got], np.int64)
            if not len(got):
                continue
            cls, flat = np.repeat(np.asarray(batch.column("cls")), sizes), np.concatenate(got)
            for k in range(0, len(flat), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[k : k + 100_000], pa.int64()) for v in (cls, flat)], ["cls", "token"])

    tokens = arrow_map(sets.select("cls", "tokens"), explode, "cls long, token long")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(common, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    ranked = ranked.join(sets.select("cls", F.expr("cast(length(tokens) div 8 as long)").alias("n")), "cls")
    # tokens of one class alone come first in the order and take up the prefix
    length = F.expr(f"cast(n - ceil({per_cent} * n / 100) + 1 - (n - size(shared)) as int)")
    second = ranked.withColumn("length", length).where("length > 0").select("cls", F.explode(F.expr("slice(shared, 1, length).token")).alias("token"))
    second = materialize(second, f"{tag}_second")
    lead = second.groupBy("token").agg(F.min("cls").alias("b"), F.count("*").alias("c")).where("c > 1").select("token", "b")
    edges = second.join(lead, "token").where("cls <> b").select(F.col("cls").alias("a"), "b").distinct()
    linked = link_families(sets, edges, per_cent, tag, **({"family_tokens": family_tokens} if family_tokens else {}))

    labels = linked.select(F.col("cls").alias("c"), "root", "links")
    named = sizes.select("doc_id", "cls", "n").join(labels, F.col("cls") == F.col("c"), "left").withColumn("group", F.coalesce("root", "cls"))
    named = materialize(named.select("doc_id", "n", "cls", "group", "links"), f"{tag}_named")
    least = named.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")).withColumnRenamed("group", "g")
    twins = named.where("cls is not null").groupBy("cls").agg((F.count("*") - 1).alias("twins")).where("twins > 0").withColumnRenamed("cls", "k")
    out = named.join(least, F.col("group") == F.col("g"), "left").join(twins, F.col("cls") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("twins", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs, all columns, with one document of each component: that of the least key. Singles stay, whatever their text.

    Of rows that repeat a kept key, each different text stays once; null keys go by the same rule; an empty table stays
    empty; further columns of any name go along. Texts are not moved, but for those whose key a pre-filter takes for a
    removed one: they are joined exactly."""
    name, place = (f"{n}_{uuid.uuid4().hex}" for n in ("key", "place"))
    found = materialize(jaccard_components(docs, text=text, key=key, **options).select("doc_id", "component_id"), "jaccard_found")
    kept = found.where("doc_id <=> component_id").groupBy("doc_id").agg(F.count("*").alias("c")).withColumnRenamed("doc_id", name)
    repeated = kept.where("c > 1").select(name)
    gone = found.where("not doc_id <=> component_id").select("doc_id").union(repeated)
    marks = docs.sparkSession.sparkContext.broadcast(bitmap_of(gone, "xxhash64(doc_id)", ID_BITS))
    placed = docs.withColumn(place, F.xxhash64(F.col(key).cast("long")))

    def part(doubtful: bool) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(marks.value, np.asarray(batch.column(place))) == doubtful)).drop_columns([place])

        return arrow_map(placed, keep, docs.schema)

    same = F.col(key).cast("long").eqNullSafe(F.col(name))
    checked = part(True).join(kept.select(name), same, "left_semi")
    if not repeated.isEmpty():
        checked = checked.join(repeated, same, "left_anti").unionByName(checked.join(repeated, same, "left_semi").dropDuplicates([key, text]))
    return part(False).unionByName(checked)
