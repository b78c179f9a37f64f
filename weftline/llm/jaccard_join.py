"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles.

Two texts link when their sets of word shingles have a Jaccard similarity of
``PERCENT`` or more. Texts of equal sets form a class, and classes are joined:

1. A first pass counts shingles in windows of some million and reports those
   that repeat; their sums name the long inverted lists (``LONG`` texts or more).
   Long lists are set aside, as DivideSkip does, and only probed later.
2. A set of n shingles that must share t = ceil(0.75 n) of them, of which L are
   in long lists, has some n - t + 1 first shingles (in the order of their
   hashes) of short lists such that two sets that link share one of these, unless
   both have L >= t. These short lists are merged: each pair's occurrences are
   counted over all of them.
3. A pair is a candidate only if its count, with all that the rest of its lists
   could add, reaches the overlap it needs. Candidates are verified on whole sets.
   Verification goes by rounds: every class's likeliest partner first; a pair
   whose classes are connected by then adds nothing and is left out.
4. Classes with L >= t (of large groups of near copies, or of passages that many
   texts share) are joined among themselves by their first shingles: those
   that share any, directly or by others, form a cluster. Some rounds compare a
   cluster's sets with one of them, the pivot: sets that link with it are one
   group and need no links with each other, and since 1 - J is a metric, a set
   farther from the pivot than two links reach has no link with its group. What is
   between is searched against that group, and what no pivot took against itself:
   in blocks, each pair of them by DivideSkip: for each query the longest lists
   are left out, the others merged, and what occurs often enough is looked up in
   the long ones by binary search.

No list, group or cluster is ever dropped, cut short or sampled; lists that turn
out long only in step 2 (over ``LONGEST``) are added to the long ones and the
step is done again. Workers hold some ten MB each: windows, pairs and signatures
are counted in sorted arrays of bounded size.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing; a text of fewer words than a shingle has its whole sequence as its one
shingle; repeated rows link with each other; rows of a null doc_id take part, and
count for a component's smallest id only if it has no other; an empty table gives
an empty result; other columns are ignored. Sets are compared by 64-bit hashes of
their shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise
from .components import components
from .shingles import WORDS, shingle_sets, signatures

PERCENT = 75
LONG = 64
LONGEST = 160
#: Shingles in a window of the first pass, and the count in it from which a shingle is reported.
WINDOW, REPORTED = 4_000_000, 3
#: Pairs that are counted at once, and signatures that a task remembers so as not to send equal sets twice.
PAIRS, REMEMBERED = 500_000, 2_000_000
#: Long lists' shingles are broadcast: at most so many, at 8 bytes each. The bar rises until they are.
MAX_LONG = 4_000_000
#: Rows of (doc_id, class) broadcast to fetch the sets that are needed, at 16 bytes each; beyond it they are joined.
MAX_WANTED = 2_000_000
ROUNDS = 2
PIVOTS = 3
#: Pivots are broadcast up to so many bytes in all; beyond it they are joined.
MAX_PIVOT_BYTES = 32 << 20
#: A block of a cluster: sets and shingles at most (one set may have more), and sets below which it isn't cut.
BLOCK_SETS, BLOCK_SHINGLES, LEAST_SETS = 2048, 500_000, 128
#: Tasks that search pairs of blocks.
MOST_TASKS = 2000
#: DivideSkip's weight of a long list's search against the merging of short ones.
MU = 0.0085


class Seen:
    """Signatures met before, up to some number, in a sorted array and a short list of newer ones."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.old, self.newer, self.n = np.empty(0, np.int64), [], 0

    def new(self, sig: np.ndarray) -> np.ndarray:
        """Which of sig weren't met before; of equal ones the first."""
        out = np.zeros(len(sig), bool)
        out[np.unique(sig, return_index=True)[1]] = True
        for known in (self.old, *self.newer):
            if len(known):
                out &= known[np.minimum(np.searchsorted(known, sig), len(known) - 1)] != sig
        self.newer.append(np.sort(sig[out]))
        self.n += len(self.newer[-1])
        if self.n > self.most:
            self.clear()
        elif len(self.newer) >= 16:
            self.old, self.newer = np.sort(np.concatenate((self.old, *self.newer))), []
        return out


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, sig, text_hash) for each row, and (token, n) for shingles repeated in a window; the others are null."""
    names = ["doc_id", "n", "sig", "token", "text_hash"]

    def run(batches):
        held, size, some = np.empty(WINDOW, np.uint64), 0, Seen(WINDOW)

        def report():
            t = held[:size]
            t.sort()
            k = REPORTED - 1
            found = np.unique(t[k:][t[k:] == t[: len(t) - k]])
            n = np.searchsorted(t, found, "right") - np.searchsorted(t, found)
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n), none, pa.array(found.view(np.int64)), none], names=names)

        for b in batches:
            for lo, hashes, sizes in shingle_sets(b.column(1), words):
                sig = signatures(hashes, sizes)
                own, text = (b.column(k).slice(lo, len(sizes)) for k in (0, 2))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(sizes), pa.array(sig, mask=sizes == 0), pa.nulls(len(sizes), pa.int64()), text], names=names
                )
                hashes = hashes[np.repeat(some.new(sig) & (sizes > 0), sizes)]  # equal sets of a window count once
                while len(hashes):
                    take = min(len(hashes), WINDOW - size)
                    held[size : size + take] = hashes[:take]
                    hashes, size = hashes[take:], size + take
                    if size == WINDOW:
                        yield report()
                        size = 0
                        some.clear()
        if size >= REPORTED:
            yield report()

    d = docs.withColumn("text_hash", F.xxhash64("text"))
    return d.mapInArrow(run, "doc_id long, n long, sig long, token long, text_hash long")


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n must be looked at."""
    return n - -(-percent * n // 100) + 1


def _postings(docs: DataFrame, long_lists, words: int, percent: int) -> DataFrame:
    """(token, sig, 0) for the first shingles of short lists; (sig, sig, 1 + rest * 2^32 + L) for each class.

    rest: shingles of short lists beyond the first ones. L: shingles of long lists.
    """

    def run(batches):
        skip = long_lists.value
        seen = Seen(REMEMBERED)
        for b in batches:
            for _, hashes, sizes in shingle_sets(b.column(0), words):
                sig = signatures(hashes, sizes)
                new = seen.new(sig) & (sizes > 0)
                hashes, sizes, sig = hashes[np.repeat(new, sizes)], sizes[new], sig[new]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                if len(skip):
                    at = np.minimum(np.searchsorted(skip, hashes), len(skip) - 1)
                    short = skip[at] != hashes
                else:
                    short = np.ones(len(hashes), bool)
                n_short = np.bincount(doc[short], minlength=len(sizes))
                hashes, doc = hashes[short], doc[short]
                rank = np.arange(len(doc)) - np.repeat(np.cumsum(n_short) - n_short, n_short)
                first = np.minimum(_prefix(sizes, percent), n_short)
                take = rank < first[doc]
                more = 1 + ((n_short - first) << 32) + (sizes - n_short)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((hashes[take].view(np.int64), sig))),
                        pa.array(np.concatenate((sig[doc[take]], sig))),
                        pa.array(np.concatenate((np.zeros(int(take.sum()), np.int64), more))),
                    ],
                    names=["token", "sig", "x"],
                )

    return docs.mapInArrow(run, "token long, sig long, x long")


def _long_lists(sizes: DataFrame, least: int, most: int | None = None) -> tuple[np.ndarray, int]:
    """The tokens of the longest lists, ``most`` of them at most (equally long ones all or none), and the size up to
    which lists are merged: the next one below, where there are more than ``most``."""
    most = MAX_LONG if most is None else most
    by_size = sizes.filter(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("lists")).orderBy(F.desc("n")).limit(1_000_000).collect()
    total, bar = 0, least
    for r in by_size:
        if total + r["lists"] > most:
            bar = r["n"] + 1
            break
        total += r["lists"]
    tokens = sizes.filter(F.col("n") >= bar).select("token").toArrow().column(0).to_numpy().view(np.uint64)
    return tokens, max(LONGEST, bar - 1)


def _merged_lists(longest: int):
    return lambda batches: _merge_lists(batches, longest)


def _merge_lists(batches, longest: int):
    """Sorted postings to (a, b, c): pairs a < b with a count, classes (a, null, x), lists over longest (token, null, -size)."""
    names = ["a", "b", "c"]
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    kept = (np.empty(0, np.int64), np.empty(0, np.int64))

    def counted():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(np.diff(np.append(first, len(a))))], names=names)

    def pairs(token, sig):
        nonlocal size
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig = token[new], sig[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        n = np.diff(np.append(start, len(token)))
        for m in np.unique(n):
            if m < 2:
                continue
            own = start[n == m]
            if m > longest:
                yield pa.RecordBatch.from_arrays([pa.array(token[own]), pa.nulls(len(own), pa.int64()), pa.array(np.full(len(own), -m))], names=names)
                continue
            i, j = np.triu_indices(m, 1)
            for lo in range(0, len(own), step := max(1, PAIRS // 4 // len(i))):
                at = own[lo : lo + step, None]
                held.append((sig[at + i].ravel(), sig[at + j].ravel()))
                size += len(held[-1][0])
                if size > PAIRS:
                    yield counted()
                    size = 0

    for batch in batches:
        token, sig, x = (batch.column(k).to_numpy() for k in range(3))
        nodes = x > 0
        if nodes.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[nodes]), pa.nulls(int(nodes.sum()), pa.int64()), pa.array(x[nodes])], names=names)
        token, sig = np.concatenate((kept[0], token[~nodes])), np.concatenate((kept[1], sig[~nodes]))
        if not len(token):
            continue
        last = np.searchsorted(token, token[-1])  # this list may go on in the next batch
        kept = (token[last:], sig[last:])
        if last:
            yield from pairs(token[:last], sig[:last])
    if len(kept[0]):
        yield from pairs(*kept)
    if held:
        yield counted()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, n, tokens) of the wanted (doc_id, sig): ascending 64-bit hashes."""
    if wanted.count() <= MAX_WANTED:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted.withColumnRenamed("doc_id", "_id"), docs.doc_id.eqNullSafe(F.col("_id"))).select("text", "sig")

    def run(batches):
        for b in batches:
            for lo, hashes, sizes in shingle_sets(b.column(0), words):
                sig = signatures(hashes, sizes)
                want = b.column(1).slice(lo, len(sizes)).to_numpy()
                ends = np.concatenate(([0], np.cumsum(sizes)))
                own = [(int(sig[i]), int(sizes[i]), hashes[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero((sig == want) & (sizes > 0))]
                if own:
                    s, n, t = zip(*own, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.binary())], names=["sig", "n", "tokens"])

    return found.mapInArrow(run, "sig long, n long, tokens binary").dropDuplicates(["sig"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    sa = sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta"))
    sb = sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["a", "b"])

    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def divide_skip(queries: list[np.ndarray], base: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """(i, j) of all queries i and sets j of base that link, by T-occurrence search over base's inverted lists."""
    if not base:
        return []
    flat = np.concatenate(base)
    owner = np.repeat(np.arange(len(base)), list(map(len, base)))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes = np.fromiter(map(len, base), np.int64, len(base))
    out = []
    for i, q in enumerate(queries):
        lo, hi = np.searchsorted(flat, q), np.searchsorted(flat, q, "right")
        n = hi - lo
        has = n > 0
        lo, hi, n = lo[has], hi[has], n[has]
        t = -(-percent * len(q) // 100)  # what any partner must share at least
        if len(n) < t:
            continue
        order = np.argsort(n, kind="stable")
        skipped = min(t - 1, int(t / (MU * np.log2(max(2, n[order[-1]])) + 1)), len(n) - 1)
        short, long = order[: len(n) - skipped], order[len(n) - skipped :]
        # the short lists, merged
        at = np.repeat(lo[short] - (np.cumsum(n[short]) - n[short]), n[short]) + np.arange(int(n[short].sum()))
        found, count = np.unique(owner[at], return_counts=True)
        some = count >= t - skipped
        found, count = found[some], count[some]
        for k in long:  # the long ones, looked up; who can't reach t any more is out
            if not len(found):
                break
            own = owner[lo[k] : hi[k]]
            p = np.minimum(np.searchsorted(own, found), len(own) - 1)
            count = count + (own[p] == found)
        out += [(i, int(j)) for j, c in zip(found, count, strict=True) if 100 * c >= percent * (len(q) + sizes[j] - c)]
    return out


def _compared(pairs: DataFrame, percent: int) -> DataFrame:
    """(cluster, sig, n, tokens, pivot, state) of sets and a pivot p (sig, tokens): 2 links, 1 may link with what links with it, 0 can't."""

    def run(batches):
        for b in batches:
            pivot = b.column(4)
            state = np.zeros(b.num_rows, np.int8)
            for i in range(b.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (b.column(3), b.column(5)))
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                state[i] = 2 if 100 * both >= percent * either else 100 * both >= (2 * percent - 100) * either
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pivot, pa.array(state)], names=["cluster", "sig", "n", "tokens", "pivot", "state"])

    d = pairs.select("cluster", "sig", "n", "tokens", F.col("p.sig").alias("pivot"), F.col("p.tokens").alias("other"))
    return d.mapInArrow(run, "cluster long, sig long, n long, tokens binary, pivot long, state byte")


def _union(frames: list[DataFrame], like: DataFrame) -> DataFrame:
    """All of frames; without any, no rows of their columns."""
    out = frames[0] if frames else like.limit(0).withColumn("pivot", F.lit(0).cast("long"))
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _cluster_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links among classes most of whose lists are long, as edges of the same components."""

    def first(batches):
        for b in batches:
            n = b.column(1).to_numpy()
            take = _prefix(n, percent)
            tokens = [np.frombuffer(x.as_buffer(), np.int64)[:k] for x, k in zip(b.column(2), take, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), take))], names=["token", "sig"]
            )

    spark = sets.sparkSession
    lists = materialise(sets.select("sig", "n", "tokens").mapInArrow(first, "token long, sig long"), "lists")
    heads = lists.groupBy("token").agg(F.min("sig").alias("head"), F.count("*").alias("size")).filter("size > 1")
    cluster = components(lists.join(heads, "token").select(F.col("head").alias("a"), F.col("sig").alias("b")))
    member = cluster.select(F.col("node").alias("sig"), F.col("component").alias("cluster")).join(sets, "sig")
    left = materialise(member.select("cluster", "sig", "n", "tokens"), "clusters")
    scratch, compared = [lists, cluster, left], []
    for _ in range(PIVOTS):
        if left.isEmpty():
            break
        pivots = materialise(left.groupBy("cluster").agg(F.min(F.struct("sig", "tokens")).alias("p")), "pivot")
        scratch.append(pivots)
        if (pivots.agg(F.sum(F.length("p.tokens"))).first()[0] or 0) <= MAX_PIVOT_BYTES:
            pivots = F.broadcast(pivots)  # sets then stay where they are, those of a large cluster too
        compared.append(materialise(_compared(left.join(pivots, "cluster"), percent), "pivots"))
        scratch.append(compared[-1])
        left = compared[-1].filter(F.col("state") < 2).select("cluster", "sig", "n", "tokens")

    of = {k: _union([c.filter(F.col("state") == k) for c in compared], left) for k in (1, 2)}
    # what is near a pivot against that pivot's group; what no pivot took against itself
    near = of[1].select(F.col("pivot").alias("of"), "sig", "n", "tokens")
    taken = of[2].select(F.col("pivot").alias("of"), "sig", "n", "tokens").join(near.select("of").distinct(), "of", "left_semi")
    apart = left.select(F.col("cluster").alias("of"), "sig", "n", "tokens")
    parts = materialise(
        near.withColumn("kind", F.lit(1)).unionByName(taken.withColumn("kind", F.lit(2))).unionByName(apart.withColumn("kind", F.lit(0))), "parts"
    )
    sizes = parts.groupBy("of", "kind").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    per = F.greatest(F.least(F.col("m") / 16, F.lit(float(BLOCK_SETS))), F.lit(float(LEAST_SETS)))
    sizes = sizes.select("of", "kind", F.greatest(F.ceil(F.col("m") / per), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = sizes.groupBy("of", F.least("kind", F.lit(1)).alias("apart")).agg(
        F.max(F.when(F.col("kind") < 2, F.col("blocks"))).alias("rows"), F.max(F.when(F.col("kind") != 1, F.col("blocks"))).alias("columns")
    )
    sizes = materialise(sizes.withColumnRenamed("of", "_of"), "blocks")
    tasks = sizes.agg(F.sum(F.when(F.col("apart") == 0, F.col("rows") * (F.col("rows") + 1) / 2).otherwise(F.col("rows") * F.col("columns")))).first()[0]
    dealt = parts.join(sizes, (F.col("of") == F.col("_of")) & (F.least("kind", F.lit(1)) == F.col("apart")))
    block = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    at = lambda i, j, query, base: F.struct(i.alias("i"), j.alias("j"), query.alias("query"), base.alias("base"))
    both, yes, no = block("rows"), F.lit(True), F.lit(False)
    places = (
        F.when(F.col("kind") == 0, each("rows", lambda k: at(F.least(k, both), F.greatest(k, both), both <= k, both >= k)))
        .when(F.col("kind") == 1, each("columns", lambda k: at(both, k, yes, no)))
        .otherwise(each("rows", lambda k: at(k, block("columns"), no, yes)))
    )
    dealt = dealt.select("of", "apart", "sig", "tokens", F.explode(places).alias("at")).select("of", "apart", "at.*", "sig", "tokens")
    keys = ["of", "apart", "i", "j"]
    dealt = dealt.repartition(int(max(1, min(tasks or 1, MOST_TASKS))), *keys)

    def search(key, group):
        sig = group.column("sig").to_numpy()
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("tokens")]
        left, right = (np.flatnonzero(group.column(k).to_numpy(zero_copy_only=False)) for k in ("query", "base"))
        found = divide_skip([tokens[k] for k in left], [tokens[k] for k in right], percent)
        # links as a forest: one that closes a circle adds nothing
        up = list(range(len(sig)))

        def top(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        a, b = [], []
        for x, y in found:
            u, v = top(int(left[x])), top(int(right[y]))
            if u != v:
                up[u] = v
                a.append(int(sig[left[x]]))
                b.append(int(sig[right[y]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = dealt.groupBy(*keys).applyInArrow(search, "a long, b long")
    to_pivot = of[2].filter(F.col("sig") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("sig").alias("b"))
    links = materialise(found.unionByName(to_pivot), "links")
    for x in (*scratch, parts, sizes):
        drop_path(spark, x.scratch)
    return links


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id (smallest doc_id of an equal set) and component_id.

    Rows without shingles are their own class and component. Further columns:
    component (a hash that also tells components of one id, or of none, apart;
    null without shingles) and text_hash.
    """
    spark, made = docs.sparkSession, []

    def kept(df: DataFrame, what: str) -> DataFrame:
        made.append(materialise(df, what))
        return made[-1]

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = kept(_scan(d, words), "scan")
    rows = scan.filter(F.col("token").isNull())
    classes = kept(rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n")), "classes")
    long_tokens, longest = _long_lists(kept(scan.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")), "long"), LONG)
    while True:
        shared = spark.sparkContext.broadcast(np.sort(long_tokens))
        postings = _postings(d.select("text"), shared, words, percent)
        dealt = postings.repartition("token").sortWithinPartitions("token", "sig")
        lists = kept(dealt.mapInArrow(_merged_lists(longest), "a long, b long, c long"), "merged")
        shared.destroy()
        late = lists.filter("b is null and c < 0").groupBy(F.col("a").alias("token")).agg(F.sum(-F.col("c")).alias("n"))
        more, bar = _long_lists(late, 0, MAX_LONG - len(long_tokens))
        if bar <= longest and not len(more):
            break
        long_tokens, longest = np.concatenate((long_tokens, more)), max(longest, bar)

    nodes = lists.filter("b is null and c > 0").select(F.col("a").alias("sig"), (F.col("c") - 1).alias("x")).distinct()
    nodes = nodes.join(classes.select("sig", "n"), "sig").select(
        "sig", "n", F.shiftright("x", 32).alias("rest"), F.col("x").bitwiseAND(F.lit((1 << 32) - 1)).alias("l")
    )
    nodes = kept(nodes, "nodes")
    na = nodes.select(*[F.col(c).alias(f"{c}_a") for c in nodes.columns])
    nb = nodes.select(*[F.col(c).alias(f"{c}_b") for c in nodes.columns])
    n = F.col("n_a") + F.col("n_b")
    needed = F.ceil(F.lit(percent) * n / (100 + percent) - 1e-9)
    most = F.col("c") + F.greatest("rest_a", "rest_b") + F.least("l_a", "l_b")
    counted = lists.filter("b is not null").groupBy("a", "b").agg(F.sum("c").alias("c"))
    pairs = (
        counted.join(na, F.col("a") == F.col("sig_a"))
        .join(nb, F.col("b") == F.col("sig_b"))
        .filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (most >= needed))
        .select("a", "b", (F.col("c") / n).alias("c"))
    )
    pairs = kept(pairs, "candidates")

    heavy = nodes.filter(F.col("l") * 100 >= percent * F.col("n")).select("sig")
    some = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).union(heavy).distinct()
    wanted = kept(classes.join(some, "sig").select(F.col("class_id").alias("doc_id"), "sig"), "wanted")
    sets = kept(_sets(d, wanted, words), "sets")

    links = kept(_cluster_links(sets.join(heavy, "sig", "left_semi"), percent), "links")
    left = pairs
    for k in range(ROUNDS + 1):
        if left.isEmpty():
            break
        tried = left.select("a", "b")
        if k < ROUNDS:  # each class's likeliest partner
            both = left.select("a", "b", "c").union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "c"))
            best = both.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
            tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = kept(links.union(_verified(tried, sets, percent)), "links")
        if k < ROUNDS:
            joined = components(links)
            ja = joined.select(F.col("node").alias("a"), F.col("component").alias("ca"))
            jb = joined.select(F.col("node").alias("b"), F.col("component").alias("cb"))
            left = left.join(tried, ["a", "b"], "left_anti").join(ja, "a", "left").join(jb, "b", "left")
            apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
            left = kept(left.filter(apart).select("a", "b", "c"), "left")
            drop_path(spark, joined.scratch)

    joined = components(links)
    placed = classes.join(joined.withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "class_id", F.coalesce("component", "sig").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(least, "component").select("sig", "class_id", "component_id", "component")
    out = rows.join(placed, "sig", "left")
    out = materialise(
        out.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("class_id", "doc_id").alias("class_id"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            "component",
            "text_hash",
        ),
        "components",
    )
    for x in (*made, joined):
        drop_path(spark, x.scratch)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id. All columns stay.

    Of several texts of that id in a component one stays, and rows of one id in
    other components aren't touched by it. Components whose rows all lack an id
    keep one row too. Rows without shingles link with nothing and stay; only
    repeated ones of an id (of equal text) count once.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    # a row of no shingles is a component by itself: its id and text name it
    alone = F.col("component").isNull()
    kept = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component", "doc_id", "text_hash")
        .agg(F.count("*").alias("rows"))
        .groupBy("component", F.when(alone, F.col("doc_id")).alias("id"), F.when(alone, F.col("text_hash")).alias("hash"))
        .agg(F.min(F.struct("text_hash", "doc_id", "rows")).alias("k"))
        .select(
            F.col("k.doc_id").alias("_kept"),
            F.col("k.text_hash").alias("_hash"),
            (alone & F.col("k.doc_id").isNull()).alias("_all"),
            F.col("k.rows").alias("_rows"),
        )
    )
    kept = materialise(kept, "kept")
    n, repeated = kept.agg(F.count("*"), F.max((F.col("_rows") > 1) & ~F.col("_all"))).first()
    kept = kept.drop("_rows")
    if n <= MAX_WANTED:
        kept = F.broadcast(kept)
    same = docs[id_col].cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    out = docs.join(kept, same)
    if repeated:
        own = F.when(F.col("_all"), F.monotonically_increasing_id())
        out = out.withColumn("_own", own).dropDuplicates(["_kept", "_hash", "_own"])
    return out.select(*[docs[c] for c in docs.columns])


def op4_query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
