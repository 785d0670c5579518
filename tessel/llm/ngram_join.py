"""Exact n-gram Jaccard self-join by vertical partitioning of the global n-gram order.

1. Documents become sets of 64-bit shingle hashes; equal sets fall into one class, so copies cost nothing more.
2. The hash order of n-grams is cut into fragments. A fragment holds the pieces of all sets that fall into it and is
   counted on its own: the document frequency of each of its n-grams. A task sends a class once, however many copies it
   reads. N-grams that would fill a fragment alone are found in a sample; they are not counted but take the last places
   of the order, and their rows are dealt by class. Any choice of such n-grams gives the same links.
3. Classes are gathered again with their n-grams of frequency two and more (the only ones that two sets can share).
   A class whose shared part is below the threshold of its size links with nothing. The others order their n-grams
   by (frequency, hash), one global order, and two sets that link must meet in a short prefix of it.
4. Pairs that meet are verified by partial overlaps, counted per fragment and summed per pair.
5. Links are needed only between different components: a list of sets that share a prefix n-gram first tests its
   members against a leader, the one with the largest shared part; only lists that still hold several components test
   the members outside the largest one against all. No candidate is capped or dropped, and a hot n-gram whose sets are all linked costs linear work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm._common import discard, local_table, partitions, staged, tidy, tidy_groups
from tessel.llm._text import lower_ascii, mix, shingle_set, word_hashes
from tessel.llm.components import connected_components

#: N-grams that a fragment should hold on average; its reducer sorts them in memory.
FRAGMENT = 500_000
#: N-grams sampled a fragment, how often one of them must be seen to count as hot, and how many are at most.
HOT_SAMPLE, HOT_SEEN, HOT_MOST = 64, 16, 100_000
#: Fragments of the verification, by the top bits of the hash.
CHECK_BITS = 2
_KEY = np.uint64(0xA0761D6478BD642F)


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set of hashes."""
    with np.errstate(over="ignore"):
        return int(mix(mix(s ^ _KEY).sum(keepdims=True) + np.uint64(len(s)))[0].astype(np.int64))


def _batches(it: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, cls): size and fingerprint of each document's set; cls is null for an empty set."""

    def run(it):
        for b in _batches(it):
            sizes, marks = [], []
            for _, w in word_hashes([lower_ascii(t) for t in b.column(1).to_pylist()]):
                s = shingle_set(w, k)
                sizes.append(len(s))
                marks.append(fingerprint(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.int64())], ["doc_id", "n_shingles", "cls"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, cls long")


def _bucket(cls: np.ndarray, buckets: int) -> np.ndarray:
    return (cls.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def hot_ngrams(docs: DataFrame, k: int, count: int, total: int) -> np.ndarray:
    """Sorted hashes of n-grams that a sample of texts finds to fill about a quarter of a fragment or more."""
    u = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(it):
        seen: set[int] = set()
        for b in _batches(it):
            for _, w in word_hashes([lower_ascii(t) for t in b.column(0).to_pylist()]):
                s = shingle_set(w, k)
                if len(s) and (mark := fingerprint(s)) not in seen:
                    seen.add(mark)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["tok"])

    some = docs.select("text").filter(u < min(1.0, HOT_SAMPLE * count / max(1, total))).mapInArrow(tidy(run), "tok long")
    most = some.groupBy("tok").agg(F.count("*").alias("n")).filter(F.col("n") >= HOT_SEEN).orderBy(F.desc("n"), "tok").limit(HOT_MOST)
    return np.sort(np.array([r["tok"] for r in most.collect()], np.int64).view(np.uint64))


def _fragments(docs: DataFrame, k: int, count: int, hot: np.ndarray) -> DataFrame:
    """(fragment, cls, n, tok): the pieces of a batch's sets in one fragment, as packed arrays.

    Fragments from `count` on hold the hot n-grams, one for each bucket of classes.
    """
    width = (1 << 64) // count + 1

    def run(it):
        seen: set[int] = set()  # classes that this task has sent
        for b in _batches(it):
            toks, marks = [], []
            for _, w in word_hashes([lower_ascii(t) for t in b.column(0).to_pylist()]):
                s = shingle_set(w, k)
                if len(s) and (mark := fingerprint(s)) not in seen:
                    seen.add(mark)
                    toks.append(s)
                    marks.append(mark)
            if not toks:
                continue
            tok, marks = np.concatenate(toks), np.array(marks, np.int64)
            frag = (tok // np.uint64(width)).astype(np.uint32)
            doc = np.repeat(np.arange(len(marks), dtype=np.int32), [len(s) for s in toks])
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, tok), len(hot) - 1)] == tok
                frag[is_hot] = count + _bucket(marks, count)[doc[is_hot]]
            order = np.argsort(frag, kind="stable")
            tok, doc, frag = tok[order], doc[order], frag[order]
            rows, cut = np.unique(frag, return_index=True)
            cut = np.append(cut, len(frag))
            out: list[list] = [[], [], []]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                d = doc[i:j]
                begin = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                out[0].append(marks[d[begin]].tobytes())
                out[1].append(np.diff(np.append(begin, len(d))).astype(np.uint32).tobytes())
                out[2].append(tok[i:j].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), *(pa.array(x, pa.binary()) for x in out)], ["fragment", "cls", "n", "tok"])

    return docs.select("text").mapInArrow(tidy(run), "fragment long, cls binary, n binary, tok binary")


def _count_fragment(buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        cls = np.frombuffer(b"".join(t.column("cls").to_pylist()), np.int64)
        n = np.frombuffer(b"".join(t.column("n").to_pylist()), np.uint32)
        tok = np.frombuffer(b"".join(t.column("tok").to_pylist()), np.uint64)
        cls = np.repeat(cls, n)
        order = np.lexsort((cls, tok))
        cls, tok = cls[order], tok[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])  # copies of a class count once
        cls, tok = cls[new], tok[new]
        first = np.ones(len(tok), bool)
        first[1:] = tok[1:] != tok[:-1]
        begin = np.flatnonzero(first)
        df = np.repeat(np.diff(np.append(begin, len(tok))), np.diff(np.append(begin, len(tok)))).astype(np.uint32)
        if key[0].as_py() >= buckets:  # hot n-grams: last in the order, and shared
            df[:] = np.iinfo(np.uint32).max
        shared = df >= 2
        cls, tok, df = cls[shared], tok[shared], df[shared]
        bucket = _bucket(cls, buckets).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        cls, tok, df, bucket = cls[order], tok[order], df[order], bucket[order]
        rows, cut = np.unique(bucket, return_index=True)
        cut = np.append(cut, len(bucket))
        packed = [[a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for a in (cls, tok, df)]
        return pa.table({"bucket": pa.array(rows.astype(np.int32)), **{k: pa.array(v, pa.binary()) for k, v in zip(("cls", "tok", "df"), packed, strict=True)}})

    return run


def _survivors(percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cls = np.frombuffer(b"".join(left.column("cls").to_pylist()), np.int64)
        tok = np.frombuffer(b"".join(left.column("tok").to_pylist()), np.uint64)
        df = np.frombuffer(b"".join(left.column("df").to_pylist()), np.uint32)
        ids, sizes = right.column("cls").to_numpy(), right.column("n_shingles").to_numpy()
        by = np.argsort(ids)
        ids, sizes = ids[by], sizes[by]
        order = np.lexsort((tok, df, cls))
        cls, tok = cls[order], tok[order]
        begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(cls)), bool), cls[1:] != cls[:-1])))
        shared = np.diff(np.append(begin, len(cls)))
        out: list[list] = [[], [], [], []]
        if len(begin):
            n = sizes[np.searchsorted(ids, cls[begin])]
            prefix = n + (-percent * n) // 100 + 1 - (n - shared)  # what is left of the prefix after the unshared n-grams
            for i in np.flatnonzero((100 * shared >= percent * n) & (prefix > 0)):
                out[0].append(cls[begin[i]])
                out[1].append(n[i])
                out[2].append(tok[begin[i] : begin[i] + shared[i]].view(np.int64))
                out[3].append(min(prefix[i], shared[i]))
        return pa.table({"cls": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "toks": pa.array(out[2], pa.list_(pa.int64())), "prefix": pa.array(out[3], pa.int32())})

    return run


def _verified(pairs: DataFrame, pieces: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose overlap, summed over the fragments, reaches the threshold."""
    one = pieces.select(F.col("cls").alias("a"), "fragment", F.col("toks").alias("toks_a"))
    two = pieces.select(F.col("cls").alias("b"), "fragment", F.col("toks").alias("toks_b"))
    part = pairs.join(one, "a").join(two, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("toks_a", "toks_b")).alias("part"))
    total = part.groupBy("a", "b").agg(F.sum("part").alias("common"))
    total = total.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("n_b")), "b")
    return total.filter((100 + percent) * F.col("common") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def linked_classes(docs: DataFrame, classes: DataFrame, k: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """(node, label) of the set classes that link with another class; label is the least class of the component.

    classes: distinct (cls, n_shingles) of docs, staged.
    """
    spark = docs.sparkSession
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    count = max(64, partitions(spark), -(-total // FRAGMENT))
    hot = hot_ngrams(docs, k, count, total)
    counted = _fragments(docs, k, count, hot).groupBy("fragment").applyInArrow(tidy_groups(_count_fragment(count)), "bucket int, cls binary, tok binary, df binary")
    sized = classes.withColumn("bucket", F.shiftright(F.shiftrightunsigned("cls", 32) * count, 32).cast("int"))
    found = counted.groupBy("bucket").cogroup(sized.groupBy("bucket")).applyInArrow(tidy_groups(_survivors(percent)), "cls long, n long, toks array<long>, prefix int")
    sets = staged(found, "sets")
    sizes = sets.select("cls", "n")
    top = F.shiftrightunsigned("t", 64 - CHECK_BITS)
    pieces = sets.select("cls", F.explode("toks").alias("t")).groupBy("cls", top.cast("int").alias("fragment")).agg(F.collect_list("t").alias("toks"))
    pieces = staged(pieces, "pieces")
    lists = sets.select("cls", "n", F.size("toks").alias("s"), F.posexplode(F.slice("toks", 1, F.col("prefix"))).alias("i", "tok"))
    lists = staged(lists.select("cls", "n", "tok", (F.col("s") - F.col("i")).alias("rest")), "lists")  # rest: shared n-grams from this one on
    labels, edges, parts = local_table(spark, {"node": pa.array([], pa.int64()), "label": pa.array([], pa.int64())}), None, []
    # at the first n-gram of its prefix that a linked pair shares, what both have left must hold their whole overlap
    near = ((100 + percent) * F.least("r_a", "r_b") >= percent * (F.col("n_a") + F.col("n_b"))) & (F.col("a") != F.col("b"))
    for r in range(rounds + 1):
        named = lists.join(labels, lists["cls"] == labels["node"], "left").select("cls", "n", "rest", "tok", F.coalesce("label", "cls").alias("label"))
        named = staged(named, "named")
        open_ = named.groupBy("tok").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct((F.col("rest") / F.col("n")).alias("q") if r == 0 else F.xxhash64(F.lit(r), "cls").alias("h"), "cls", "n", "rest", "label")).alias("lead"))
        open_ = staged(open_.filter("lo <> hi"), "open")
        if r < rounds:
            pairs = named.join(open_, "tok").filter("label <> lead.label").select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b"), F.col("lead.rest").alias("r_a"), F.col("rest").alias("r_b"))
        else:
            rest = staged(named.join(open_.select("tok"), "tok"), "rest")
            held = rest.groupBy("tok", "label").agg(F.count("*").alias("m"))
            most = staged(held.groupBy("tok").agg(F.max_by("label", F.struct("m", "label")).alias("most")), "most")
            some = staged(rest.join(most, "tok").filter("label <> most").select("tok", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("r_a"), F.col("label").alias("l_a")), "some")
            every = rest.select("tok", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("r_b"), F.col("label").alias("l_b"))
            pairs = some.join(every, (some["tok"] == every["tok"]) & (F.col("l_a") != F.col("l_b")) & near).select("a", "b", "n_a", "n_b", "r_a", "r_b")
        pairs = staged(pairs.filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        new = staged(_verified(pairs, pieces, sizes, percent), "links")
        parts.append(new)
        discard(named, open_, pairs, *((rest, most, some) if r == rounds else ()))
        if edges is not None and new.isEmpty():
            break
        if edges is not None:
            discard(labels)
        edges = new if edges is None else new.unionByName(edges)
        labels = connected_components(edges)
    discard(sets, pieces, lists, *parts)
    return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): components under Jaccard >= percent / 100 of k-word shingle sets.

    Words are runs without ASCII white space, A-Z lower-cased. A document with fewer than k words has its whole
    sequence as its one shingle; one without words (null or empty text) has an empty set and links with nothing.
    component_id is the least doc_id reachable by links. Copies (equal sets) are one class, and component ids come
    from class representatives plus membership. Sets are compared by 64-bit hashes. A null doc_id takes part, but is
    never a component's least id; a component of null ids only has a null id. Whole texts are read, a long one in
    slices. Repeated rows are each answered alike. Columns besides doc_id and text are ignored, whatever their names.
    An empty table gives an empty result.
    """
    narrow = staged(document_classes(docs, k), "narrow")
    grouped = narrow.filter("cls is not null").groupBy("cls").agg(F.max("n_shingles").alias("n_shingles"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = staged(grouped, "classes")
    labels = linked_classes(docs, classes.select("cls", "n_shingles"), k, percent)
    joined = classes.join(labels, classes["cls"] == labels["node"], "left").filter("copies > 1 or label is not null").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    joined = staged(joined, "joined")
    firsts = joined.groupBy("label").agg(F.min("least").alias("component"))
    of = staged(joined.join(firsts, "label").select("cls", "component"), "members")
    discard(classes, joined, labels)
    out = narrow.join(of, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
