"""Each operator against brute force or a round trip, and on odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import (
    components,
    decontamination,
    encoding,
    html_text,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    pii,
    quality,
    shingles,
    token_files,
    topk_search,
)

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, w string, n_words long, sig long, start long, spans string"


def docs_of(spark, texts):
    """Documents with columns whose names clash with those used inside."""
    rows = [(i, t, "en", "s", None, 7, "x", 1, 2, 3, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "lorem ipsum dolor sit amet " * 20_000
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "one two"), (5, "ümlaut 日本語 \x00 😀"), (6, LONG), (7, "!!! ###"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, []).limit(0)


# --- encoding, packing, files ------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_library(path):
    r = random.Random(1)
    texts = ["".join(r.choice("ab  \n\n\t's'reXÉöß12²½İ.,!|<>　中😀́\x1c'll") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("ab  \n\n\t'sreXSTÉöß12.,!|<>'ll×'S'RE") for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>", ""]
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    flat, sizes = encoding.BatchEncoder(path).encode(texts)
    ids, at = np.frombuffer(flat, "<u4"), 0
    for t, n in zip(texts, sizes, strict=True):
        assert ids[at : at + n].tolist() == tok.encode(t, add_special_tokens=False).ids, t
        at += n


def encoded(path, texts, end):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def test_packing(spark, odd, empty):
    assert packing.op1_query(empty, WORD).count() == 0
    texts = [t for _, t in ODD]
    rows = packing.op1_query(odd, WORD).collect()
    sequences = collections.defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append(x)
    for own in sequences.values():
        at = 0
        for x in sorted(own, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    want = collections.Counter()
    for (i, _), ids in zip(ODD, encoded(WORD, texts, 1), strict=True):
        want[i, len(ids)] += len(ids)
        for x in (x for x in rows if x.doc_id == i and x.doc_tokens == len(ids)):
            assert x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes())
    got = collections.Counter()
    for x in rows:
        got[x.doc_id, x.doc_tokens] += x.length
    assert got == want


def test_packing_has_little_padding(spark, sf):
    rows = packing.op1_query(spark.read.parquet(f"{sf}/documents.parquet"), WORD).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in rows) > 0.97 * 2048 * len(rows)


def test_bins_of_a_worker():
    r = random.Random(3)
    w, sizes = packing.Worker(100, 8, 4), [r.choice([1, 3, 7, 20, 33, 34, 50, 51, 99, 100, 260]) for _ in range(900)]
    pieces = [w.add(n) for n in sizes]
    assert [sum(p) for p in pieces] == sizes
    flat = [n for p in pieces for n in p]
    # what isn't placed yet stands in open bins, fewer pieces than close one
    rest = w.rest()
    assert sorted([*w.placed, *(p for p, _ in rest)]) == list(range(len(flat))) and len(rest) <= sum(range(1, 8))
    ends = collections.defaultdict(list)
    for p, (b, at) in w.placed.items():
        ends[b].append((at, flat[p]))
    assert sorted(ends) == list(range(w.bins))
    waiting = {b for b, _, _ in w.gaps}
    for b, own in ends.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert 100 - 4 < at <= 100 or b in waiting
    assert packing.best_fit([5, 0, 6, 4], 10) == [(1, 0), (0, 0), (0, 0), (0, 6)]


def test_packing_keeps_texts_whole(spark, sf):
    """Only as much is cut as closed bins have room for."""
    rows = packing.op1_query(spark.read.parquet(f"{sf}/documents.parquet"), WORD).filter("doc_tokens <= 2048").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert sum(r.n > 1 for r in rows) < 0.5 * len(rows)


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    assert token_files.op8_query(spark, empty, BYTE).count() == 0
    index = token_files.write_token_files(odd, BYTE, 2, f"file://{tmp_path}/t")
    order = sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    want, at = [], 0
    for (i, _), ids in zip(order, encoded(BYTE, [t for _, t in order], 2), strict=True):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    rows = token_files.read_token_files(spark, f"file://{tmp_path}/t").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert index["dtype"] == "<u2" and sum(s["ids"] for s in index["shards"]) == at
    flat = np.concatenate([np.fromfile(f"{tmp_path}/t/{s['name']}.ids", "<u2") for s in index["shards"]])
    assert len(flat) == at and (flat == 2).sum() >= len(ODD)


# --- top-k -------------------------------------------------------------------------------------------------------


def brute_top(rows, every, k):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.setdefault(i, []).append([math.floor(256 * x) for x in v])
    out = {}
    for q in (i for i in valid if i % every == 0):
        found = []
        for qv in {tuple(x) for x in valid[q]}:
            found += [(-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, vs in valid.items() if i != q for v in vs]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def test_top_k_brute(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(i, [0.25] * 6) for i in range(400, 470)]  # ties
    rows += [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, [1.0] * 6), (550, [3000.0, -70.5, 0.0, 0.0, 1e5, 2.0]), (600, [0.5]), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n int")
    got = collections.defaultdict(list)
    for x in topk_search.op2_query(df).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(rows, 50, 5)
    assert topk_search.op2_query(df.limit(0)).count() == 0


def test_top_k_of_rows_repeated_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 3)
    monkeypatch.setattr(topk_search, "CHUNK_BYTES", 100)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(4)]) for i in range(12)]
    rows += [(0, [1.0] * 4), (20, [2.0] * 4), (21, [2.0, 2.0])] + [(20, [2.0] * 4)] * 7
    got = collections.defaultdict(list)
    for x in topk_search.op2_query(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(rows, 50, 5)


def test_slices():
    v = np.array([0, 1, -1, 127, -128, 5])
    s = topk_search.slices(v)
    bits = np.unpackbits(s.view(np.uint8), axis=1, bitorder="little")[:, : len(v)].astype(np.int64)
    weight = np.array([1 << k for k in range(len(s))])
    weight[-1] *= -1
    assert (weight @ bits).tolist() == v.tolist()


# --- quality, language -------------------------------------------------------------------------------------------


def test_quality_held_out(spark, empty, odd):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    rows = quality.op3_query(d, l).join(l, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.op3_query(empty, l).count() == 0
    assert quality.op3_query(odd, l.limit(0)).count() == len(ODD)


def test_quality_reads_only_training_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))  # noqa: E741
    flipped = l.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.op3_query(d, x).collect())) for x in (l, flipped))
    assert a == b


def test_suffix_automaton():
    r = random.Random(3)
    for _ in range(30):
        s = [r.randrange(3) for _ in range(r.randint(0, 25))]
        t = language_id.suffix_automaton(s, 3)
        subs = {tuple(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)} | {()}

        def has(w, t=t):
            state = 0
            for c in w:
                state = t[state, c]
                if state < 0:
                    return False
            return True

        for n in range(5):
            for k in range(3**n):
                w = tuple(k // 3**i % 3 for i in range(n))
                assert has(w) == (w in subs)


def brute_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        n, at = n + 1, at + k
    return n


def test_cross_parsing_counts():
    r = random.Random(9)
    sample = "".join(r.choice("abc ") for _ in range(200)).replace("  ", " ")
    p = language_id.Parser({"x": [sample]}, ["x"])
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(200)]
    found, sizes, _ = p.phrases(texts)
    for t, n, size in zip(texts, found[:, 0], sizes, strict=True):
        assert n == brute_phrases(sample, t) and size == len(t)


@pytest.mark.parametrize("segment", [1, 2, 7, 64])
def test_phrases_run_across_segments(monkeypatch, segment):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    monkeypatch.setattr(language_id, "SYMBOLS", 3)
    r = random.Random(segment)
    samples = ["".join(r.choice("abc日 ") for _ in range(n)).replace("  ", " ") for n in (500, 40)]
    p = language_id.Parser({"x": samples[:1], "y": samples[1:]}, ["x", "y"])
    texts = ["".join(r.choice("abc日d") for _ in range(r.randint(0, 300))) for _ in range(60)] + [samples[0][100:400].strip()]
    found, sizes, letters = p.phrases(texts)
    for t, n, size in zip(texts, found.tolist(), sizes, strict=True):
        assert n == [brute_phrases(x, " ".join(t.split())) for x in samples] if "  " not in t else True
    # the winner: the fewest phrases, of equals the first; the score: how far it is below the next
    lang, score = p.predict(texts)
    for n, x, s, ok in zip(found.tolist(), lang, score, letters, strict=True):
        assert (x, round(s, 9)) == ((["x", "y"][n[1] < n[0]], round(1 - min(n) / max(n), 9)) if ok else ("und", 0.0))


def test_languages_of_many_scripts():
    r = random.Random(2)
    # languages of one script differ in which letters follow each other, not in lengths
    spans = {"zh": (0x4E00, 400), "zh2": (0x4E00, 400), "ja": (0x3041, 80), "ko": (0xAC00, 500), "gothic": (0x10330, 20), "ru": (0x430, 30), "el": (0x3B1, 16)}
    vocabulary = {lang: ["".join(chr(a + r.randrange(n)) for _ in range(r.randint(1, 3))) for _ in range(150)] for lang, (a, n) in spans.items()}
    text = lambda lang, n: " ".join(r.choice(vocabulary[lang]) for _ in range(n))
    p = language_id.Parser({lang: [text(lang, 200) for _ in range(20)] for lang in spans}, sorted(spans))
    wanted = [lang for lang in spans for _ in range(10)]
    assert p.predict([text(lang, 30) for lang in wanted])[0] == wanted


def test_cross_parsing_counts_of_rare_letters(monkeypatch):
    monkeypatch.setattr(language_id, "SYMBOLS", 2)
    r = random.Random(4)
    sample = "".join(r.choice("abc日本語😀𐌰 ") for _ in range(300)).replace("😀", " ").replace("  ", " ").replace("  ", " ")
    p = language_id.Parser({"x": [sample]}, ["x"])
    texts = ["".join(r.choice("ab日本語𐌰中d") for _ in range(r.randint(1, 60))) for _ in range(200)]
    for t, n in zip(texts, p.phrases(texts)[0][:, 0], strict=True):
        assert n == brute_phrases(sample, t)


def test_language_held_out(spark, odd, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op7_query(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    got = language_id.op7_query(odd).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got} <= {"en", "und"}
    assert sum(r.lang_pred == "und" for r in got) == sum(not re.search(r"[^\W\d_]", t or "") for _, t in ODD)
    assert language_id.op7_query(empty).count() == 0
    assert {r.lang_pred for r in language_id.op7_query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- near duplicates ---------------------------------------------------------------------------------------------


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles_of(t):
    w = words_of(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    up[top(i)] = top(j)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[top(k)].append(i)
    return collections.Counter((i, len(sets[k]), min(ids[top(k)]) if sets[k] and ids[top(k)] else i) for k, (i, _) in enumerate(rows))


def near_corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    passage = [word() for _ in range(50)]
    rows = []
    for g in range(14):
        base = [word() for _ in range(r.choice([3, 8, 40, 120]))]
        if g % 3 == 0:
            base += passage
        for _ in range(r.choice([1, 2, 5, 25])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(t)))
    return rows


FEW = {"LONG": 2, "LONGEST": 2}


@pytest.mark.parametrize(
    "limits",
    # lists of two texts are long in the last three: nearly all classes are in clusters, which are cut into several blocks, without pivots, with one, and with three
    [{}, {"LONG": 4, "LONGEST": 6}, {"MAX_LONG": 5}, {**FEW, "LEAST_SETS": 2, "PIVOTS": 0}, {**FEW, "LEAST_SETS": 2, "PIVOTS": 1}, {**FEW, "MAX_PIVOT_BYTES": 0}],
)
def test_near_duplicates_brute(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rows = near_corpus(sum(limits.values()) % 7) + [(900 + k, t) for k, (_, t) in enumerate(ODD)] + [(None, "one two three four five six")]
    got = collections.Counter(map(tuple, jaccard_join.op4_query(docs_of(spark, rows)).collect()))
    assert got == brute_components(rows)


def test_near_duplicates_odd(spark, odd, empty):
    assert jaccard_join.op4_query(empty).count() == 0
    got = jaccard_join.op4_query(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.n_shingles == 1 and r.doc_id in (None, 4)} == {4}


def test_one_of_each(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (2, "q r s t u v"), (4, "")]
    got = jaccard_join.one_of_each(docs_of(spark, rows))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4] and got.columns == docs_of(spark, rows).columns


def test_one_of_each_keeps_unlinked_texts(spark):
    x, near, y, z = ("a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "one two three four five six", "red green blue white black grey")
    some = lambda rows: collections.Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs_of(spark, rows)).collect())
    assert some([(3, x), (7, near), (7, y)]) == {(3, x): 1, (7, y): 1}
    assert some([(7, y), (7, z), (7, z)]) == {(7, y): 1, (7, z): 1}
    assert sorted(i for i, _ in some([(7, x), (7, near)])) == [7]
    assert some([(None, y), (None, y), (None, z), (None, x), (5, near), (8, "q r s t u v")]) == {(None, y): 1, (None, z): 1, (5, near): 1, (8, "q r s t u v"): 1}
    assert some([(None, ""), (None, ""), (None, None), (None, "!!"), (4, ""), (4, ""), (4, "!")]) == {(None, ""): 2, (None, None): 1, (None, "!!"): 1, (4, ""): 1, (4, "!"): 1}


def test_divide_skip_brute():
    r = random.Random(8)
    sets = [np.unique(np.array([r.randrange(40) for _ in range(r.randint(1, 30))], np.uint64)) for _ in range(120)]
    want = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))]
    assert sorted(jaccard_join.divide_skip(sets, sets)) == want


def test_shingle_hashes():
    texts = [t for _, t in near_corpus(5)] + [t for _, t in ODD]
    for _, flat, sizes in shingles.shingle_sets(pa.array(texts)):
        assert sizes.tolist() == [len(shingles_of(t)) for t in texts]
    one = lambda t: next(iter(shingles.shingle_sets(pa.array([t]))))[1].tolist()
    assert one("A b C d E f") == one("xx\n".replace("xx", "a b c d e f")) != one("a b c d f e")


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[top(a)] = top(b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert set(got) == linked
    same = collections.defaultdict(set)
    for n in linked:
        same[top(n)].add(got[n])
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


# --- PII ---------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            d = [int(c) for c in m[0] if c.isdigit()]
            fits = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}
            if fits[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_brute():
    r = random.Random(2)
    for _ in range(20_000):
        t = "".join(r.choice("aZ9901234.@-+ (%)é\n:") for _ in range(r.randint(0, 45)))
        assert pii.base_spans(t) == brute_spans(t)
    card = "4111 1111 1111 1111"
    t = f"x {card}, +1 (555) 555-0100 a.b@c.example.org 10.0.0.255"
    assert [(pii.KINDS[k], t[s:e]) for s, k, e in pii.base_spans(t)] == [("card", card), ("phone", "+1 (555) 555-0100"), ("email", "a.b@c.example.org"), ("ip", "10.0.0.255")]


def test_base_spans_of_long_runs():
    for t in ("1" * 100_000, "a" * 100_000, "1." * 50_000, "@" * 50_000, "a@" * 30_000, "+1 " * 30_000):
        pii.base_spans(t)


def test_contexts_find_identifiers(spark):
    texts = [f"write to mail: user{i}@host.example.org today" for i in range(40)] + ["their mail: k9x7q2m4z1 is new", "no mail: here", "lot k9x7q2m4z1 again", "other 2024-01-01 date"]
    got = {r.doc_id: r for r in pii.op5_query(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got[40].spans == "id:12:22" and got[42].spans == "id:4:14" and got[41].spans == got[43].spans == "" and got[40].n_email == 0
    assert got[0].spans == "email:15:37" and got[0].base_sha256 == hashlib.sha256(b"email:15:37").hexdigest()


def test_found_identifiers_support_contexts(spark):
    found = [f"k9x7q2m4z{i:02d}" for i in range(40)]
    rows = [("mail", f"user{i}@host.example.org", True) for i in range(600)] + [("mail", v, False) for v in found]
    rows += [("key", v, False) for v in [*found, "q1w2e3r4t5"]] + [("lot", v, False) for v in found[:4]]
    graph = spark.createDataFrame(rows, "pattern string, value string, seed boolean")
    assert {r.pattern for r in pii.sure_patterns(graph).collect()} == {"mail", "key"} == brute_sure(rows)


def brute_sure(rows, bad=frozenset()):
    """Patterns that are sure after the rounds, by loops over sets."""
    seed = {v for _, v, y in rows if y}
    score, held = {v: float(v in seed) for _, v, _ in rows}, set(seed)
    for _ in range(pii.ROUNDS):
        of = collections.defaultdict(set)
        for p, v, _ in rows:
            of[p].add(v)
        worth = {p: sum(score[v] for v in vs) / (len(vs) + pii.SMOOTHING) for p, vs in of.items()}
        sure = {p for p, vs in of.items() if worth[p] >= pii.SURE and len(vs & held) >= pii.SUPPORT}
        for v in score:
            if v not in seed and v not in bad:
                score[v] = pii.DECAY * max(worth[p] for p, vs in of.items() if v in vs)
                if any(v in of[p] for p in sure):
                    held.add(v)
    return sure


def test_scores_of_random_graphs(spark):
    r = random.Random(11)
    for _ in range(3):
        seeds = {f"v{i}" for i in range(120) if r.random() < 0.6}
        bad = {f"v{i}" for i in range(120) if f"v{i}" not in seeds and r.random() < 0.2}
        rows = sorted({(f"p{(p := r.randrange(25))}", f"v{r.randrange(5 * p % 90, 5 * p % 90 + 30)}") for _ in range(700)})
        rows = [(p, v, v in seeds) for p, v in rows if v not in bad or r.random() < 0.3]
        graph = spark.createDataFrame([(p, v, y, v in bad) for p, v, y in rows], "pattern string, value string, seed boolean, bad boolean")
        assert {x.pattern for x in pii.sure_patterns(graph).collect()} == brute_sure(rows, bad)


def test_secrets_and_what_resembles_them(spark):
    r = random.Random(12)
    secret = lambda: "".join(r.choice("0123456789abcdef") for _ in range(39)) + "7a"
    texts = [f'one two token = "{secret()}" three' for _ in range(30)] + [f'a cookie = "{secret()}" b' for _ in range(3)]
    texts += [f"the {9_000_000_000_000_000 + 10 * i} word" for i in range(9)] + ["version = 2024-01-01 x", 'name = "chapter12" y', "see k9x7q2m4z1 there"]
    got = {x.doc_id: x for x in pii.op5_query(docs_of(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_id for i in range(len(texts))] == [1] * 33 + [0] * 12 and all(x.n_spans == x.n_id + x.n_card for x in got.values())
    assert got[0].spans == f"id:{texts[0].index(chr(34)) + 1}:{texts[0].rindex(chr(34))}"


def test_patterns():
    assert pii.patterns('my Token =  "ab12-cd34ef" x', 13, 24) == (['w\ttoken\t = "\t"', 's\t = "\th4-h6\t"'], True)
    assert pii.context("x" * 100 + " " * 50 + "1", 150) == ("x" * 100, " ") and pii.context("word\n1a2b", 5) is None is pii.context("1a2b", 0)
    assert [pii.shape(x) for x in ("12ab", "1234_abcd", "xy9z", "DEAD12")] == ["h4", "d4-h4", "a4", "h6"]


def test_identifiers_of_any_length():
    key = "a1b2" * 100
    assert pii.identifiers(f"key: {key}, b", []) == [(5, 405)]


def test_pii_odd(spark, odd, empty):
    assert pii.op5_query(empty).count() == 0
    got = pii.op5_query(odd).collect()
    assert len(got) == len(ODD) and {r.spans for r in got} == {""}


def test_redaction(spark):
    rows = [(1, "a x@y.example b 10.0.0.1 é c@d.example"), (2, None), (3, "plain"), (1, "a x@y.example b 10.0.0.1 é c@d.example")]
    got = pii.redact(docs_of(spark, rows))
    assert got.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "a [email] b [ip] é [email]"), (1, "a [email] b [ip] é [email]"), (2, ""), (3, "plain")]


# --- decontamination, licenses -----------------------------------------------------------------------------------


def norm_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_decontaminated(rows, items, n=13):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = norm_words(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = norm_words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return collections.Counter(out)


@pytest.mark.parametrize("anchors", [20_000, 0])
def test_decontamination_brute(spark, monkeypatch, odd, empty, anchors):
    monkeypatch.setattr(decontamination, "MAX_LITERAL_ANCHORS", anchors)
    r = random.Random(4)
    words = ["a", "bb", "Ccc", "É", "é", "dddd", "x9"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 2, 5, 13, 14, 30])))) for i in range(12)] + [(99, None), (3, "a bb")]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", ", ", "-"]) for _ in range(r.randint(0, 300)))) for i in range(30)]
    rows += [(100 + k, " zz " * r.randint(0, 400) + t + " zz" * r.randint(0, 90)) for k, (_, t) in enumerate(items) if t] + ODD
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    assert collections.Counter(map(tuple, decontamination.op6_query(docs_of(spark, rows), bench).collect())) == brute_decontaminated(rows, items)
    assert decontamination.op6_query(empty, bench).count() == 0
    assert {r.n_hit for r in decontamination.op6_query(odd, bench.limit(0)).collect()} == {0}


def test_removal(spark):
    item = " ".join(f"w{i}" for i in range(15))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (2, "One, " * 400 + item.upper() + ". End!"), (3, "clean"), (4, None)]
    got = {r.doc_id: r.text for r in decontamination.remove(docs_of(spark, rows), bench).collect()}
    assert set(got) == {2, 3, 4} and got[3] == "clean" and got[4] is None
    assert got[2] == ("One, " * 400).rstrip(", ") + ". End!"


def brute_licenses(rows):
    sets = [(set(t.split()), label) for t, label in license_scan.TEMPLATES]
    out = []
    for i, t in rows:
        w, places, found, best = norm_words(t), [], set(), 0.0
        for p, label in license_scan.PHRASES:
            p = p.split()
            places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        for a in range(0, len(w), license_scan.BLOCK_WORDS // 2):
            if a and len(w) - a <= license_scan.BLOCK_WORDS // 2:
                continue
            b = set(w[a : a + license_scan.BLOCK_WORDS])
            for s, label in sets:
                if len(s & b) >= license_scan._needed(len(s), license_scan.THRESHOLD):
                    found.add(label)
                    best = max(best, len(s & b) / len(s))
        base = {x for _, x in places}
        at = [k for k, _ in places]
        out.append((i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if places else best))
    return collections.Counter(out)


def test_licenses_brute(spark, odd, empty):
    r = random.Random(7)
    vocabulary = sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["zz"]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(0, 5)):
            w = r.choice(license_scan.TEMPLATES)[0].split() if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
            w = [r.choice(vocabulary) if r.random() < 0.06 else x.upper() if r.random() < 0.1 else x for x in w]
            lines.append(r.choice([" ", ", "]).join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(200, "Under the MIT License; CC BY-NC 4.0. Apache License, Version 2.0")] + ODD
    assert collections.Counter(map(tuple, license_scan.op10_query(docs_of(spark, rows)).collect())) == brute_licenses(rows)
    assert license_scan.op10_query(empty).count() == 0


def test_wrapped_notices(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:",
        "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published",
    }
    before = " ".join(f"word{i}" for i in range(45))
    rows = [(i, f"{before}\n{notice}\n{before}") for i, notice in enumerate(notices.values())]
    got = {r.doc_id: r for r in license_scan.op10_query(docs_of(spark, rows)).collect()}
    assert [got[i].labels for i in range(3)] == list(notices) and all(r.score == 1.0 and r.n_base == 0 for r in got.values())
    assert all(len(t.split()) <= license_scan.BLOCK_WORDS // 2 for t, _ in license_scan.TEMPLATES)


# --- pages -------------------------------------------------------------------------------------------------------


def test_blocks_of_a_page():
    page = "<p>a &amp; <b>b</b>\n  c<p>d<script>var x='</p>'</script><!-- x --><ul><li>e<li><a href=x>f</a></ul>g &lt;3 <br>h 1 < 2"
    got = html_text.blocks(page)
    assert [b.text for b in got] == ["a & b c", "d", "e", "f", "g <3 h 1 < 2"]
    assert got[3].linked == 1 and got[3].path == ("ul", "li", "a")
    for odd in ("", "<", "<<<>>>", "</p></div>", "<p", "<a href='", "<!--", "<script>", "\x00", "<" * 5000):
        html_text.blocks(odd)


def test_long_malformed_pages_take_linear_time():
    import time

    n = 250_000
    for page in ('<a "' * n, "<a '\"" * n, "<a" * n, "<a b=\"" * n + ">", "<svg><title>" * (n // 3), "</p>" * n, "<div>x" * (n // 5) + "</i>" * (n // 5), "<!--" * n, "<li>x" * (n // 5)):
        began = time.process_time()
        html_text.blocks(page)
        assert time.process_time() - began < 5, page[:20]
    # beyond the depth that browsers nest, texts stay
    assert len(html_text.blocks("<div>x" * 2000)) == 2000


def test_tags_end_as_the_pattern_says():
    pattern, r = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), random.Random(5)
    for _ in range(3000):
        page = "".join(r.choice("ab=\"'> <") for _ in range(r.randint(0, 30)))
        tags = html_text._Tags(page)
        for at in sorted(r.sample(range(len(page) + 1), min(3, len(page)))):
            m = pattern.match(page, at)
            assert tags.end(at) == (m.end() - 1 if m else -1), (page, at)


def test_main_text_odd(spark):
    schema = "page_id long, url string, html string, text string, n_chars long, row long"
    assert html_text.op9_query(spark.createDataFrame([], schema)).count() == 0
    body = "<article><h1>Head</h1><p>A long sentence of the article stands here, and it goes on for a while.</p></article><footer>&copy; x</footer>"
    rows = [(1, "u", body, "t", 5, 9), (1, "u", body, "t", 5, 9), (None, None, body, None, None, None), (2, "u", None, "x", 1, 1), (3, "u", "<p>" * 3000 + "x", "", 0, 0)]
    got = html_text.op9_query(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert len({r.text for r in got if r.page_id in (1, None)}) == 1 and [r.text for r in got if r.page_id == 2] == [""]


def test_embedded_elements():
    texts = lambda page: [b.text for b in html_text.blocks(page)]
    for tag in ("svg", "math", "object"):
        assert texts(f"<article><p>a</p><{tag}><p>b</p><p>c</p></article><p>d</p>") == ["a", "b", "c", "d"]
        assert texts(f"<div>a<{tag}>b</div><div>c</div>") == ["ab", "c"]
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert texts(f"<p>Here {formula} holds.</p>") == ["Here x=1 holds."]
    assert texts("<p>A <svg><title>logo</title><g><path d='M0'/><text>B</text></g></svg> c</p><p>d</p>") == ["A B c", "d"]
    assert texts("<p>a</p><svg><title>b<p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><object><p>b</p></object><p>c</p><script>d<p>e</p>") == ["a", "b", "c"]
    # what follows an unclosed one isn't inside it
    assert [b.path for b in html_text.blocks("<article><svg><p>a</p></article>")] == [("article", "p")]


def test_gradients():
    r = np.random.default_rng(0)
    net = html_text.Labeller(hidden=3, seed=1)
    for k in net.w:
        net.w[k] = net.w[k].astype(np.float64)
    pages, labels = [], []
    for n in (3, 5):
        own = [html_text.Block(("div", ".x"), f"some words number {i}", 0) for i in range(n)]
        pages.append(html_text.features(own))
        labels.append(r.integers(0, 2, n).astype(float))

    def loss():
        p = net.scores(pages)
        return -sum((y * np.log(q) + (1 - y) * np.log(1 - q)).sum() for q, y in zip(p, labels, strict=True)) / 8

    g = net._gradients(pages, labels)
    for name in ("wf", "uf", "bf", "ub", "out", "path", "word"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep = net.w[name][at]
        net.w[name][at] = keep + 1e-2
        up = loss()
        net.w[name][at] = keep - 1e-2
        down = loss()
        net.w[name][at] = keep
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-3 + 0.03 * abs(g[name][at]), name


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    own = spark.createDataFrame([(900_001, "u", None), (900_002, "u", ""), (900_003, "u", "<p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.op9_query(pages.unionByName(own)).collect()}
    good = total = 0
    for r in pages.collect():
        m = re.search(r"<article>(.*?)</article>", r.html, re.S)
        want = "\n".join(b.text for b in html_text.blocks(m[1]))
        good += got[r.page_id].text == want
        total += 1
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert good / total >= 0.98 and all(got[i].text == "" for i in (900_001, 900_002, 900_003))


def test_main_text_of_other_layouts(spark, sf):
    texts = ["A long sentence of the article stands here, and it goes on for a while.", "More of it follows, with commas, and stops."] * 3
    net = html_text.train(spark.read.parquet(f"{sf}/pages.parquet"))
    page = (
        "<html><body><div id='top-menu'><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></div><div class='post-content'><h1>Title here</h1>"
        + "".join(f"<p>{t}</p>" for t in texts)
        + "</div><div id='comments'><div class='comment'><p>I liked it, thanks for the post.</p></div></div><footer><p>&copy; site</p></footer></body></html>"
    )
    got = html_text.main_texts([page], net)[0]
    assert got == "\n".join(["Title here", *texts])


def test_deep_layouts(spark):
    net = html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    texts = ["A long sentence of the article stands here, and it goes on for a while.", "More of it follows, with commas, and stops."] * 2
    replies = ["I liked it a lot, thanks for the post, it was good to read.", "No, it is wrong, and I say so here, since nobody else does."]
    for seed, opening in enumerate(("<section class='comments'>", "<div id='comments'>", "<aside>", "<div class='sidebar'>", "<div class='cookie-notice'>")):
        r = random.Random(seed)

        def deep(lines, r=r):
            inner = "".join(f"<p>{x}</p>" for x in lines)
            for _ in range(12):
                inner = f"<div class='{' '.join(r.sample('grid row col flex px py inner wrap box layout shell panel stack gap'.split(), 4))}'>{inner}</div>"
            return inner

        page = f"<html><body><article>{deep(texts)}</article>{opening}{deep(replies)}</{opening[1:].split()[0].strip('>')}></body></html>"
        assert html_text.main_texts([page], net) == ["\n".join(texts)]


def test_all_words_of_a_block_count():
    text = " ".join(f"word{i}" for i in range(100))
    a, b = (html_text.features([html_text.Block(("p",), f"{text} {end}", 0)]) for end in ("alpha omega", "gamma delta"))
    net = html_text.Labeller()
    assert (net.scores([a])[0] != net.scores([b])[0]).all() and (a[2] == b[2]).all()
