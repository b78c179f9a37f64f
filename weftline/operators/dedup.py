"""Exact, mirror and near duplicates of pages, and the greedy pass over all three.

Exact duplicates are a window over the content hash. Mirror duplicates (kin of
one path with near fingerprints) depend on who was kept before, in order of
arrival; kin are independent of each other, so each group of kin is one ordered
pass. Near duplicates across paths, and a cap on pages, couple all pages of a
scan: then the scan is one pass, but over fingerprints only, never over texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.simhash import hamming, simhash
from ..functions.text import content_hash, page_signature
from ..functions.url import sibling_key
from ..scratch import materialise

MIRROR, NEAR, REEMITTED = 8, 0, 3


def fingerprinted(pages: DataFrame, text: str = "markdown", url: str = "url") -> DataFrame:
    """pages with hash, fingerprint and sibling_key: one scan, whose texts no later step reads again."""
    p = pages.withColumn("_signature", page_signature(F.col(text))).withColumn("sibling_key", sibling_key(F.col(url)))
    return p.withColumn("hash", F.sha1("_signature")).withColumn("fingerprint", simhash(F.col("_signature"))).drop("_signature")


def exact(pages: DataFrame, scan: str = "scan_id", seq: str = "seq", key: str = "hash") -> DataFrame:
    """pages with ``first_seq``, the arrival of the first page of the same content, and ``is_first``.

    A partial minimum and a join, not a window: a group of copies of any size is split over tasks.
    """
    first = pages.groupBy(F.col(scan).alias("_scan"), F.col(key).alias("_key")).agg(F.min(seq).alias("first_seq"))
    same = F.col(scan).eqNullSafe(F.col("_scan")) & F.col(key).eqNullSafe(F.col("_key"))
    out = pages.join(first, same).drop("_scan", "_key")
    return out.withColumn("is_first", F.col(seq) == F.col("first_seq"))


class _Prints:
    """Fingerprints of pages that were kept, with the numbers of their urls; all are compared at once."""

    def __init__(self):
        self.n, self.fps, self.urls = 0, np.empty(16, np.uint64), np.empty(16, np.int64)

    def add(self, fp: np.uint64, url: int) -> None:
        if self.n == len(self.fps):
            self.fps, self.urls = np.resize(self.fps, 2 * self.n), np.resize(self.urls, 2 * self.n)
        self.fps[self.n], self.urls[self.n] = fp, url
        self.n += 1

    def near(self, fp: np.uint64, most: int, url: int | None = None) -> bool:
        """Whether one, of another url if one is given, differs in ``most`` bits at most."""
        close = np.bitwise_count(self.fps[: self.n] ^ fp) <= most
        return bool(close.any() if url is None else (close & (self.urls[: self.n] != url)).any())


def decide(rows: list[tuple[int, str, str, str, int]], mirror: int, near: int, cap: int | None) -> list[str]:
    """The fate of each (seq, url, hash, sibling_key, fingerprint), in order: keep, exact, mirror, near or over."""
    seen: set[str] = set()
    numbers: dict[str, int] = {}
    kin: dict[str, _Prints] = {}
    index = _Prints()
    out, kept = [], 0
    for _, url, digest, key, fp in rows:
        if cap is not None and kept >= cap:
            out.append("over")
            continue
        if digest in seen:
            out.append("exact")
            continue
        seen.add(digest)  # even if the page goes: its twins then are exact
        own, number, fp = kin.get(key) if key else None, numbers.setdefault(url, len(numbers)), np.uint64(int(fp) & 0xFFFFFFFFFFFFFFFF)
        if mirror > 0 and own and own.near(fp, mirror, number):
            out.append("mirror")
            continue
        if near > 0:
            if index.near(fp, near):
                out.append("near")
                continue
            index.add(fp, number)
        if key:
            kin.setdefault(key, _Prints()).add(fp, number)
        kept += 1
        out.append("keep")
    return out


def tiers(
    pages: DataFrame, mirror: int = MIRROR, near: int = NEAR, max_pages: int | None = None, scan: str = "scan_id", seq: str = "seq", url: str = "url"
) -> DataFrame:
    """(scan, seq, fate) of each page of (scan, seq, url, hash, sibling_key, fingerprint).

    A page is judged by what was kept before it; a page dropped as mirror still makes its later twins exact.
    """
    mirror, near = (max(0, min(64, x)) for x in (mirror, near))
    p = pages.select(F.col(scan).alias("scan"), F.col(seq).alias("seq"), F.col(url).alias("url"), "hash", "sibling_key", "fingerprint")
    p = exact(materialise(p, "pages"), "scan")  # keys are written once: the join reads both its sides from there
    # later twins are settled natively; only first pages enter the ordered pass
    first = p.filter("is_first")
    coupled = near > 0 or max_pages is not None
    rest = p.filter("not is_first").select("scan", "seq", "first_seq")

    kinds = tuple(to_arrow_type(p.schema[c].dataType) for c in ("scan", "seq"))
    names = ("scan", "seq", "url", "hash", "sibling_key", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one group, which lie together in order
        group: tuple | None = None

        def judged(done: list[list[tuple]]) -> pa.RecordBatch:
            fates = [(r[0], r[1], f) for g in done for r, f in zip(g, decide([r[1:] for r in g], mirror, near, max_pages), strict=True)]
            scans, seqs, found = zip(*fates, strict=True) if fates else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(scans, kinds[0]), pa.array(seqs, kinds[1]), pa.array(found, pa.string())], ["scan", "seq", "fate"])

        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = (row[0],) if coupled else (row[0], row[4])
                if own != group and held:
                    done.append(held)
                    held = []
                group = own
                held.append(row)
            yield judged(done)
        yield judged([held])

    keys = ["scan"] if coupled else ["scan", "sibling_key"]
    # most groups are single pages: they go by in one stream, as a call for each would cost far more than its pages
    dealt = first.select(*names).repartition(*keys).sortWithinPartitions(*keys, "seq", "url", "hash")
    judged = dealt.mapInArrow(run, f"scan {dict(p.dtypes)['scan']}, seq {dict(p.dtypes)['seq']}, fate string")
    later = rest.select("scan", "seq", F.lit("exact").alias("fate"))
    if max_pages is not None:  # a twin that arrives after the cap was reached isn't counted
        full = judged.filter("fate = 'over'").groupBy("scan").agg(F.min("seq").alias("full"))
        kept = judged.filter("fate = 'keep'").groupBy("scan").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
        ends = kept.join(full, "scan", "left").withColumn("last", F.when(F.col("n") >= max_pages, F.col("last")))
        later = rest.join(ends, "scan", "left").select(
            "scan", "seq", F.when(F.col("seq") > F.col("last"), "over").otherwise("exact").alias("fate")
        )
    return judged.unionByName(later).withColumnsRenamed({"scan": scan, "seq": seq})


def near_pairs(pages: DataFrame, most: int = REEMITTED, id_col: str = "id", fingerprint: str = "fingerprint", within: str | None = None) -> DataFrame:
    """(a, b, distance), after ``within`` if only pages of one value of that column are compared: the links of pages whose fingerprints differ in ``most`` bits at most.

    Pages of one fingerprint (such as all that have no tokens) are a class, known by its smallest id. Rows are the
    pairs of classes, and each class's smallest id with its other members (distance 0): no link is lost, and copies
    aren't expanded. The bits are cut into blocks; of those that ``most`` differing bits leave equal, some r meet in an
    equi-join, for each choice of r blocks: keys of half the bits or so, which few classes share by chance.
    """
    r = 3 if most <= 4 else 2 if most <= 10 else 1
    n = min(64, most + r)
    ends = [64 * k // n for k in range(n + 1)]
    own = [within] if within else []
    p = materialise(pages.select(*own, F.col(id_col).alias("id"), F.col(fingerprint).alias("fp")).filter(F.col("fp").isNotNull()), "prints")
    classes = p.groupBy(*own, "fp").agg(F.min("id").alias("rep"))

    def mask(blocks: tuple[int, ...]) -> int:
        bits = sum(((1 << (ends[k + 1] - ends[k])) - 1) << ends[k] for k in blocks)
        return bits - (1 << 64) if bits >> 63 else bits

    keys = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(mask(c))).alias("bits")) for i, c in enumerate(combinations(range(n), min(r, n)))]
    met = classes.select(*own, "fp", "rep", F.explode(F.array(*keys)).alias("at")).select(*own, "fp", "rep", "at.*")
    # sizes are guessed from before the rows are exploded: without the hints the driver would hold all keys for a broadcast
    x, y = (met.withColumnsRenamed({"fp": f"f{c}", "rep": f"r{c}"}).hint("merge") for c in "xy")
    met = x.join(y, [*own, "table", "bits"]).filter("fx < fy").withColumn("distance", hamming(F.col("fx"), F.col("fy"))).filter(F.col("distance") <= most)
    apart = met.select(*own, F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b"), "distance").distinct()
    same = p.join(classes.hint("merge"), [*own, "fp"]).filter("id > rep").select(*own, F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(same)


def drop_counts(fates: DataFrame, scan: str = "scan_id") -> DataFrame:
    """Kept pages and duplicates by tier for each scan, and for all (scan null)."""
    n = lambda f: F.count_if(F.col("fate") == f).alias(f)
    return fates.rollup(scan).agg(n("keep"), n("exact"), n("mirror"), n("near"))


def replayed(journal: DataFrame, scan: str = "scan_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(pages, seeds) from journal records (scan, seq, page, links): exact twins are skipped, but all links stay."""
    j = journal.withColumn("hash", content_hash(F.col("page.markdown")))
    pages = exact(j, scan, seq).filter("is_first").drop("is_first", "first_seq")
    seeds = journal.select(scan, F.explode("links").alias("url")).distinct()
    return pages, seeds


def not_reemitted(produced: DataFrame, earlier: DataFrame, most: int = REEMITTED, within: str | None = None) -> DataFrame:
    """Rows of produced (id, fingerprint) that no earlier output, and none kept before them, comes near; ``within``
    names a column of both, of which only rows of one value are compared.

    Near ones meet by the joins of ``near_pairs``. Among new outputs it goes by rounds: one before which no neighbour is
    open any more stays, and its later neighbours go, until none is open. Of equal fingerprints the smallest id stands
    for all.
    """
    own = [within] if within else []
    key = [*own, "fingerprint"]
    known = earlier.select(*key).distinct()
    new = produced.groupBy(*key).agg(F.min("id").alias("id")).join(known, key, "left_anti")
    old = known.withColumn("id", F.lit(None).cast(dict(produced.dtypes)["id"]))
    nodes = materialise(new.select(*key, "id", F.lit(True).alias("new")).unionByName(old.select(*key, "id", F.lit(False).alias("new"))), "outputs")
    pairs = near_pairs(nodes, most, "fingerprint", within=within).drop("distance")  # fingerprints name themselves
    a, b = (nodes.select(*own, F.col("fingerprint").alias(c), F.col("id").alias(f"id_{c}"), F.col("new").alias(f"new_{c}")) for c in "ab")
    links = materialise(pairs.join(a, [*own, "a"]).join(b, [*own, "b"]), "links")
    gone = links.filter("new_a <> new_b").select(*own, F.when(F.col("new_a"), F.col("a")).otherwise(F.col("b")).alias("fingerprint")).distinct()
    left = materialise(nodes.filter("new").select(*key, "id").join(gone, key, "left_anti"), "open")
    first = F.col("id_a") < F.col("id_b")
    follows = links.filter("new_a and new_b").select(
        *own, F.when(first, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("later")
    )
    kept = left.limit(0)
    while not left.isEmpty():
        for side in ("first", "later"):
            follows = follows.join(left.select(*own, F.col("fingerprint").alias(side)), [*own, side], "left_semi")
        follows = materialise(follows.select(*own, "first", "later"), "follows")
        stay = materialise(left.join(follows.select(*own, F.col("later").alias("fingerprint")).distinct(), key, "left_anti"), "stay")
        out = follows.join(stay.select(*own, F.col("fingerprint").alias("first")), [*own, "first"], "left_semi")
        kept = kept.unionByName(stay)
        left = materialise(left.join(stay.select(*key).union(out.select(*own, F.col("later").alias("fingerprint"))).distinct(), key, "left_anti"), "open")
    return kept.select(*own, "id", "fingerprint")
