"""Near-duplicate documents by min-max hashing of word shingles.

Each of `permutations` hash functions gives two values of a document's shingle set, its smallest and
its largest, so a signature needs half as many hash evaluations as it has values. Either agrees
between two sets with the probability of their Jaccard similarity. Signatures are cut into bands;
documents with an equal band are candidates.

Sets that are equal are merged first, by a 128-bit fingerprint. Then each bucket links its members
to one of them only, the one that shares buckets most often (the text that the others were made from
rather than one of its variants), so a bucket of m documents gives m - 1 candidates; these are
confirmed on full sets and components formed. Buckets that still hold several components are compared
in blocks: the members outside the head's component with all members, on full sets again. Every pair of a
bucket is thus compared or already joined, and no bucket meets in one task. Groups of equal sets and buckets
of any size are split into parts wherever rows meet what is known of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, lower_ascii, salt, salts_held, salts_of, sized, with_group, words

#: White space that ends words: space and the controls from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
PERMUTATIONS, ROWS = 60, 5
#: A pair of one block is confirmed on full sets if its signatures agree this much less than the threshold; about six
#: standard deviations: a pair at a threshold of 0.80 is passed over less than once in a million, beyond it more rarely still.
MARGIN = 0.20
#: Members and shingles of a block's side, about; pairs of one head that a task confirms.
BLOCK, BLOCK_SHINGLES, PARTNERS = 512, 4_000_000, 1024

_ODD = (np.random.default_rng(1).integers(0, 2**63, 4 + 4 * PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a document's runs of `size` words, or of all its words if they are fewer."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i]) * _ODD[2]
    return np.unique(out)


def signatures(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """A row for each nonempty set: all minima, then all maxima."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((2 * permutations, len(sets)), dtype=np.uint64)
    for begin in range(permutations):
        x = (flat ^ _ODD[4 + 2 * begin]) * _ODD[5 + 2 * begin]
        np.minimum.reduceat(x, starts, out=out[begin])
        np.maximum.reduceat(x, starts, out=out[permutations + begin])
    return out.T


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` values."""
    cut = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(np.arange(cut.shape[1], dtype=np.uint64), cut.shape[:2]).copy()
    for i in range(rows):
        key = mix(key + cut[:, :, i])
    return key


def _hash_lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column(batch.num_columns - 1)
    flat, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _runs(sets: list[np.ndarray], limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Bounds of runs of documents with about `limit` shingles, so that hashing stays in the cache."""
    begin = load = 0
    for i, s in enumerate(sets):
        load += len(s)
        if load >= limit:
            yield begin, i + 1
            begin, load = i + 1, 0
    if begin < len(sets):
        yield begin, len(sets)


def text_hash(text: Column) -> Column:
    """Tells the texts of one key apart; null is as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def word_hashes(df: DataFrame, *columns: str, text: str) -> DataFrame:
    """The columns, and `words`: a 64-bit hash of every word of the lower-cased text, in order."""
    split = words(lower_ascii(F.col(text)), SPACE)
    return df.select(*columns, F.transform(split, lambda w: F.xxhash64(w)).alias("words"))


def _array(lists: np.ndarray, of: pa.DataType) -> pa.Array:
    """Rows of a matrix as an array of lists."""
    offsets = np.arange(len(lists) + 1, dtype=np.int32) * lists.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(lists.ravel(), of))


def sketch(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, doc, text_hash, n_shingles, f1, f2, bands, values) of every row: set size, fingerprint, band keys and short signature.

    Rows without words or key have a size of 0 and nulls.
    """
    own = df.select(df[key].alias("key"), df[key].cast("long").alias("doc"), text_hash(df[text]).alias("text_hash"), df[text].alias("text"))
    hashed = word_hashes(own, "key", "doc", "text_hash", text="text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(1)
            sets = [shingles(h, size) if known else h[:0] for h, known in zip(_hash_lists(batch), docs.is_valid().to_pylist(), strict=True)]
            for a, b in _runs(sets):
                full = [i for i in range(a, b) if len(sets[i])]
                sizes = pa.array([len(s) for s in sets[a:b]], pa.int64())
                columns = [pa.nulls(b - a, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())]
                if full:
                    own = [sets[i] for i in full]
                    signature = signatures(own, PERMUTATIONS)
                    starts = np.cumsum([0, *map(len, own)])[:-1]
                    flat = mix(np.concatenate(own) + _ODD[3])
                    prints = [np.add.reduceat(x, starts).view(np.int64) for x in (flat, mix(flat))]
                    keys = band_keys(signature, ROWS).view(np.int64)
                    short = (mix(signature) >> np.uint64(48)).astype(np.uint16).view(np.int16)
                    places = np.full(b - a, -1)
                    places[np.array(full) - a] = np.arange(len(full))
                    at = pa.array([None if k < 0 else int(k) for k in places], pa.int64())
                    columns = [x.take(at) for x in (*map(pa.array, prints), _array(keys, pa.int64()), pa.array([row.tobytes() for row in short], pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), docs.slice(a, b - a), batch.column(2).slice(a, b - a), sizes, *columns], ["key", "doc", "text_hash", "n_shingles", "f1", "f2", "bands", "values"])

    return hashed.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, doc long, text_hash long, n_shingles long, f1 long, f2 long, bands array<long>, values binary")


def shingle_sets(hashed: DataFrame, size: int) -> DataFrame:
    """(doc, shingles): the full set of each document, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(h, size) for h in _hash_lists(batch)]
            for a, b in _runs(sets, 1 << 20):
                offsets = np.cumsum([0, *(len(s) for s in sets[a:b])], dtype=np.int32)
                flat = np.concatenate([np.sort(s.view(np.int64)) for s in sets[a:b]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc", "shingles"])

    return hashed.mapInArrow(run, "doc long, shingles array<long>")


def _sets(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(doc, shingles) of the given documents (doc), after their texts (doc, text) are picked."""
    wanted = cut(docs.distinct())
    return shingle_sets(word_hashes(texts.join(sized(wanted, 16), "doc", "left_semi"), "doc", text="text"), size)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= threshold * union on full sets. Only candidates' sets are made.

    A document may be the `b` of any number of pairs: its set is copied once for each PARTNERS of them.
    """
    dealt = with_group(pairs, ["b"], ["a"], {"n": ("count(*)", "sum(n)")}).withColumn("parts", F.ceil(F.col("n") / PARTNERS).cast("int"))
    pairs = cut(dealt.withColumn("part", F.pmod(F.hash("a"), F.col("parts"))).select("a", "b", "part"))
    sets = cut(_sets(pairs.select("a").union(pairs.select("b")).toDF("doc"), texts, size))
    with_a = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("of_a")), "a")
    copies = pairs.select("b", "part").distinct().join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("of_b")), "b")
    with_b = with_a.join(copies, ["b", "part"])
    both, sum_of = F.size(F.array_intersect("of_a", "of_b")).cast("long"), (F.size("of_a") + F.size("of_b")).cast("long")
    return cut(with_b.where(both * 100 >= (sum_of - both) * threshold).select("a", "b").distinct())


def _block_links(members: DataFrame, values: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links (a, b) between different components that share a bucket, enough to join all that are linked.

    Of a bucket (bucket, doc, n_shingles, head, component), the members outside the head's component meet all
    members. Both sides are dealt into chunks, and each two chunks meet in a task of their own. There,
    pairs of different components whose signatures nearly reach the threshold are compared on
    full sets; a link makes two components one, so two chunks give fewer links than members.
    """
    least = (threshold / 100 - MARGIN) * 2 * PERMUTATIONS
    known = {"own": ("max(if(doc = head, component, null))", "max(own)"), "lo": ("min(component)", "min(lo)"), "hi": ("max(component)", "max(hi)"), "n": ("count(*)", "sum(n)"), "load": ("sum(n_shingles)", "sum(load)")}
    open_ = with_group(members, ["bucket"], ["doc"], known, "lo <> hi and n > 2").withColumn("other", F.col("component") != F.col("own"))
    others = {"k": ("count_if(other)", "sum(k)"), "few": ("sum(if(other, n_shingles, 0))", "sum(few)")}
    chunks = lambda n, load: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(load) / BLOCK_SHINGLES)).cast("int")
    dealt = with_group(open_.select("bucket", "doc", "n_shingles", "component", "other", "n", "load"), ["bucket"], ["doc"], others)
    dealt = cut(dealt.withColumns({"rows": chunks("k", "few"), "columns": chunks("n", "load"), "h": F.hash("doc")}).drop("n", "load", "k", "few"))
    known = cut(values.join(_sets(dealt.select("doc"), texts, size), "doc").dropDuplicates(["doc"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt.where("other").select("bucket", F.expr("pmod(h, rows)").alias("i"), every("columns").alias("j"), "doc", "component", F.lit(True).alias("left"))
    right = dealt.select("bucket", every("rows").alias("i"), F.expr("pmod(h, columns)").alias("j"), "doc", "component", F.lit(False).alias("left"))
    met = left.union(right).join(known, "doc")

    def block(rows: pa.Table) -> pa.Table:
        docs, component, side = rows["doc"].to_numpy(), rows["component"].to_numpy().copy(), rows["left"].to_numpy()
        signature = np.frombuffer(b"".join(rows["values"].to_pylist()), dtype=np.int16).reshape(len(docs), -1)
        lists = rows["shingles"].combine_chunks()
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        length = np.diff(offsets)
        columns = np.flatnonzero(~side)
        a, b = [], []
        for k in np.flatnonzero(side):
            rest = columns[component[columns] != component[k]]
            small, large = np.minimum(length[rest], length[k]), np.maximum(length[rest], length[k])
            rest = rest[small * 100 >= large * threshold]  # no intersection is larger than the smaller set
            near = rest[(signature[rest] == signature[k]).sum(1) >= least] if len(rest) else rest
            if not len(near):
                continue
            own = flat[offsets[k] : offsets[k + 1]]
            theirs = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in near])
            place = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[place] == theirs).astype(np.int64), np.cumsum([0, *length[near]])[:-1])
            for j in near[both * 100 >= (length[k] + length[near] - both) * threshold]:
                if component[j] != component[k]:
                    component[component == component[j]] = component[k]
                    a.append(docs[k])
                    b.append(docs[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(met.groupBy("bucket", "i", "j").applyInArrow(block, "a long, b long").distinct())


PRINTS = ["f1", "f2", "n_shingles"]


def linked_groups(rows: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """(f1, f2, n_shingles, first, salts, component) of every group of equal sets in rows, as sketch() makes them.

    `first` is the group's smallest document; groups are linked if 100 * intersection >= threshold *
    union, and the component is the smallest document reachable. `salts` tells into which parts the group's rows fall.
    """
    own = rows.where("f1 is not null").select("doc", *PRINTS, salt("doc").alias("__salt"))
    parts = own.groupBy(*PRINTS, "__salt").agg(F.min("doc").alias("first"))
    groups = cut(parts.groupBy(*PRINTS).agg(F.min("first").alias("first"), salts_held().alias("salts")))
    heads = rows.join(groups.select(F.col("first").alias("doc"), *PRINTS), ["doc", *PRINTS], "left_semi").dropDuplicates(["doc", *PRINTS])
    members = cut(heads.select("doc", "n_shingles", F.explode("bands").alias("bucket")))
    shared = cut(with_group(members, ["bucket"], ["doc"], {"n": ("count(*)", "sum(n)")}, "n > 1"))
    company = shared.groupBy("doc").agg(F.sum("n").alias("company"))
    best = {"best": ("max(struct(company, -doc as minus))", "max(best)")}
    named = with_group(shared.join(company, "doc"), ["bucket"], ["doc"], best)
    members = cut(named.select("bucket", "doc", "n_shingles", (-F.col("best.minus")).alias("head")))
    links = confirm(members.where("doc <> head").select(F.col("doc").alias("a"), F.col("head").alias("b")).distinct(), texts, size, threshold)
    labels = cut(components(links))
    labelled = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    more = _block_links(labelled, heads.select("doc", "values"), texts, size, threshold)
    labels = cut(components(links.union(more)))
    return groups.join(labels.withColumnRenamed("node", "first"), "first", "left").withColumn("component", F.coalesce("component", "first"))


def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, threshold: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept, text_hash) for every row.

    Words are split at ASCII white space after A-Z are lower-cased. A set is that of the runs of
    `size` words; with fewer words, the whole sequence is the one element. Null, empty and blank texts
    have an empty set and are linked with nothing; so are null keys, whose size is 0, whose component is null
    and which are kept. Repeated rows give repeated rows. Rows that share a key and not a text go each by
    its own text, and all its texts' links count. Other columns are ignored; an empty table gives an empty one.
    """
    rows = cut(sketch(df, key, text, size))
    texts = df.where(F.col(key).isNotNull()).select(df[key].cast("long").alias("doc"), df[text].alias("text"))
    known = linked_groups(rows, texts, size, threshold).select(*PRINTS, "component", F.explode(salts_of("salts")).alias("__salt"))
    own = rows.select("key", "doc", "text_hash", *PRINTS, salt("doc").alias("__salt")).join(known, [*PRINTS, "__salt"], "left")
    component = F.coalesce("component", "doc")
    return own.select(F.col("key").alias(key), F.col("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"), "text_hash")
