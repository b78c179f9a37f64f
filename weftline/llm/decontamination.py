"""Benchmark decontamination: a broadcast hash set of test n-grams against the windows of each text.

Every benchmark item gives its windows of ``n`` consecutive words (an item of
fewer words, but not none, is one window). The windows' hashes and, as an
anchor, the longest word of each window form the broadcast side, if their numbers
are in bounds that are checked first. A text's words are scanned once; where an
anchor stands, the window around it is hashed, looked up by anchor and hash, and
then compared word by word. Beyond the bounds the same steps are joins: words that
are anchors are found by a shuffled join, and so are the windows around them.

Defined cases: null or wordless texts have ``n_words`` 0 and no hits; null or
wordless items have no windows; the same text under two item ids counts for
both; rows repeated in ``docs`` each get a row; an empty table gives an empty
result; other columns of the inputs are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, same_rows, words

N = 13
#: Up to so many distinct anchors are sent as a literal set, and so many windows are broadcast; beyond it they are joined.
MAX_LITERAL_ANCHORS, MAX_BROADCAST_WINDOWS = 20_000, 200_000
#: Rows of hits broadcast to change texts; beyond it they are joined.
MAX_BROADCAST_ROWS = 200_000
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, len, gram, anchor, at): each distinct window of each item, its longest word and where that stands."""
    w = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    w = w.select("item_id", "w", size.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    w = w.select("item_id", "len", F.slice("w", F.col("i"), F.col("len")).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda x: F.char_length(x)))
    at = F.array_position(F.transform("gram", lambda x: F.char_length(x)), longest).cast("int")
    return (
        w.withColumn("at", at)
        .select("item_id", "len", "gram", "at", F.element_at("gram", F.col("at")).alias("anchor"))
        .withColumn("hash", F.xxhash64("gram"))
        .distinct()
    )


def _around(w: Column, n: int, i: Column) -> Column:
    """A place of an anchor, from 1, and the words from n-1 before it to n-1 after it."""
    lo = F.greatest(i - (n - 1), F.lit(1))
    return F.struct(i.alias("i"), lo.alias("lo"), F.slice(w, lo, i + n - lo).alias("ctx"))


def _anchored(w: Column, n: int, anchors: list[str]) -> Column:
    """Places of anchors, each with the words around it."""
    places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(anchors) if anchors else F.lit(False), i + 1)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: _around(w, n, i))


def find_windows(
    docs: DataFrame, windows: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scan, hits): scan has (row, doc_id, n_words); hits has (row, item_id, start, len), start from 0.

    ``row`` names rows; by default they are numbered as they are read.
    """
    row = F.monotonically_increasing_id() if row is None else row
    windows = materialise(windows, "windows")
    found = windows.select("anchor").distinct().limit(MAX_LITERAL_ANCHORS + 1).collect()
    d = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    n_words = F.size("w").cast("long").alias("n_words")
    if len(found) <= MAX_LITERAL_ANCHORS:
        scan = materialise(d.select("row", "doc_id", n_words, _anchored(F.col("w"), n, [r[0] for r in found]).alias("places")), "scan")
        seen = scan.select("row", F.explode("places").alias("p"))
    else:
        scan = materialise(d.select("row", "doc_id", n_words, "w"), "scan")
        at = scan.select("row", F.posexplode("w").alias("i", "anchor")).join(windows.select("anchor").distinct(), "anchor", "left_semi")
        # rows that are equal in all but their place in the table have one name each
        held = scan.select("row", "w").dropDuplicates(["row"])
        seen = at.select("row", F.col("i") + 1).distinct().toDF("row", "i").join(held, "row").select("row", _around(F.col("w"), n, F.col("i")).alias("p"))
    seen = seen.select("row", "p.i", "p.lo", "p.ctx", F.element_at("p.ctx", F.col("p.i") - F.col("p.lo") + 1).alias("anchor"))
    # where a window with this anchor would begin; then by the hash of what stands there, which no anchor makes hot
    near = windows.select("anchor", "at", "len").distinct()
    want = windows.select("hash", F.col("len").alias("n"), F.col("gram").alias("want"), "item_id")
    if windows.count() <= MAX_BROADCAST_WINDOWS:
        near, want = F.broadcast(near), F.broadcast(want)
    begin = F.col("i") - F.col("at") + 1  # of the window in the text, from 1
    inside = (begin >= F.col("lo")) & (begin - F.col("lo") + F.col("len") <= F.size("ctx"))
    # also where it is evaluated before the filter, a slice begins at 1 at least
    gram = F.slice("ctx", F.greatest(begin - F.col("lo") + 1, F.lit(1)), F.col("len"))
    grams = seen.join(near, "anchor").filter(inside).select("row", (begin - 1).alias("start"), "len", gram.alias("gram"))
    hits = (
        grams.withColumn("hash", F.xxhash64("gram"))
        .join(want, "hash")
        .filter((F.col("len") == F.col("n")) & (F.col("gram") == F.col("want")))
        .select("row", "item_id", "start", "len")
    )
    return scan.select("row", "doc_id", "n_words"), hits


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted as strings), spans of hit words, contaminated.

    A word inside any occurrence of a window is hit; a text is contaminated if it
    has hits and ``share * n_hit >= n_words``.
    """
    return _judged(*find_windows(docs, benchmark_windows(benchmark, n), n, id_col, text_col), share).drop("row")


def _judged(scan: DataFrame, hits: DataFrame, share: int) -> DataFrame:
    ends = F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))
    per = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(ends)).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    # hit words: what each span adds beyond the end of those before it
    added = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    per = per.withColumn("n_hit", added.cast("long"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return scan.join(per, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def without_words(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and the signs before each of them."""
    own = F.filter(F.split(text, NOT_WORD_ANY_CASE), lambda w: w != "")
    between = F.split(text, WORD_ANY_CASE)  # one more than words
    # both are zipped first: what stands in a function of elements is evaluated for each of them
    pairs = F.zip_with(F.slice(between, 1, F.size(own)), own, lambda sep, w: F.struct(sep.alias("sep"), w.alias("w")))
    kept = F.transform(
        pairs,
        lambda p, i: F.when(F.exists(spans, lambda s: (s["start"] <= i) & (i < s["end"])), "").otherwise(
            F.concat(p["sep"], p["w"])
        ),
    )
    return F.concat(F.array_join(kept, ""), F.element_at(between, -1))


def remove(
    docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs without contaminated rows; from rows with fewer hits the hit words go. All columns stay."""
    key = same_rows(F.col(id_col), F.col(text_col))
    judged = _judged(*find_windows(docs, benchmark_windows(benchmark, n), n, id_col, text_col, key), share)
    # rows of one key are equal, and so are their hits
    found = judged.filter("n_hit > 0").select(F.col("row").alias("_row"), F.col("spans").alias("_spans"), F.col("contaminated").alias("_out"))
    found = materialise(found.dropDuplicates(["_row"]), "hits")
    if found.count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    out = docs.withColumn("_key", key).join(found, F.col("_key") == F.col("_row"), "left").filter("_out is null or not _out")
    text = F.col(text_col)
    changed = F.when(F.col("_spans").isNull(), text).otherwise(without_words(text, F.col("_spans")))
    return out.select(*[changed.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op6_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = decontaminate(docs, benchmark)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: The same result in DuckDB's SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""
